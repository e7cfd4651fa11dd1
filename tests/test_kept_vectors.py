import os
import uuid

import numpy as np
import pytest

from logloom.functions import vectors as V

SCHEMA = "dataset string, line_id long, normalised string"


def _counting(folder, scale):
    """An encoder that notes how many texts it was given."""
    def factory():
        def encode(lines):
            with open(os.path.join(folder, f"{len(lines)}-{uuid.uuid4().hex}"), "w"):
                pass
            return np.array([[scale, float(len(x)) + 1.0] for x in lines])
        return encode
    return V.encode_with(factory)


def test_nothing_is_encoded_twice(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "kept")
    calls.mkdir()

    def encoded():
        return sum(int(x.split("-")[0]) for x in os.listdir(calls))

    one = spark.createDataFrame([("d", 1, "a"), ("d", 2, "bb"), ("e", 3, "a"), ("e", 4, None)], SCHEMA)
    first = V.kept_encode(one, path, "m", encoder=_counting(str(calls), 1.0)).collect()
    assert len(first) == 4 and encoded() == 3
    again = V.kept_encode(one, path, "m", encoder=_counting(str(calls), 1.0)).collect()
    assert sorted(map(str, again)) == sorted(map(str, first)) and encoded() == 3
    more = one.unionByName(spark.createDataFrame([("d", 5, "cccc"), ("d", 6, "")], SCHEMA))
    got = {r["line_id"]: r["embedding"] for r in V.kept_encode(more, path, "m", encoder=_counting(str(calls), 1.0)).collect()}
    assert encoded() == 4 and set(got) == {1, 2, 3, 4, 5, 6} and got[4] == got[6]
    assert np.allclose(got[5], np.array([1, 5]) / np.sqrt(26), atol=1e-6)
    other = V.kept_encode(one, path, "other", encoder=_counting(str(calls), 9.0)).collect()
    assert encoded() == 7 and {r["line_id"]: r["embedding"] for r in other}[1] != got[1]
    assert V.kept_encode(one.limit(0), path, "m", encoder=_counting(str(calls), 1.0)).count() == 0
    with pytest.raises(ValueError):
        V.kept_encode(one, path, "")
