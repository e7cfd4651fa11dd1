"""op1, op3, op4, op5 and op9: each against a plain version, and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from texts import SCHEMA, corpus, words

from logloom.llm import lz_fingerprint as L
from logloom.llm import quality_rules as Q
from logloom.llm import secret_dfa as D
from logloom.llm import sp_viterbi as V
from logloom.llm import token_files as T

ODD = [(1, None), (2, ""), (None, "a b"), (4, "x"), (4, "x"), (5, "\n\n \t"), (6, "𝒳é 日本\x1c " * 300), (7, "z" * 20_000), (8, "a b " * 5_000)]


def rows(spark):
    return spark.createDataFrame(ODD + [(100 + d, t) for d, t in corpus(4)], SCHEMA)


def by_id(frame):
    return {(r.doc_id if r.doc_id is not None else -1): r for r in frame.collect()}


# ------------------------------------------------------------------ op1


def test_rules_count_as_told(spark):
    docs = rows(spark)
    got = by_id(Q.apply_rules(docs))
    for r in docs.collect():
        w, g = words(r.text), got[-1 if r.doc_id is None else r.doc_id]
        found = {}
        for i in range(len(w) - 4):
            found.setdefault(tuple(w[i : i + 5]), []).append(i)
        again = {k for at in found.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(again))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
    assert Q.apply_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_rules(spark):
    good = "This is a sentence of quite a few words."
    bad = ["home | about | contact | help", "a b c%%% d### e&&& f***", "BUY!! NOW!! HERE!! OK!!", "Copyright. All rights reserved.", "a line of more than eight words without an end"]
    for line in bad:
        assert Q.line_fails(line.encode(), len(line.split())), line
    for line in (good, "Ti.", "He said (so) to them all, and they went home.", "1 < 2 is true in every one of the cases that we know of here."):
        assert not Q.line_fails(line.encode(), len(line.split())), line
    more = "Another one follows here, with other words in it."
    docs = spark.createDataFrame([(1, f"{good}\n{bad[0]}\n{more}", 9, "s"), (2, "\n".join(bad), 9, None), (3, None, None, "t")], "doc_id long, text string, n_chars int, n_words string")
    assert [tuple(r) for r in Q.keep_clean(docs).collect()] == [(1, f"{good}\n{more}", len(good) + len(more) + 1, "s")]


# ------------------------------------------------------------------ op3


def test_files_hold_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, docs = Tokenizer.from_file(path), rows(spark)
    manifest, read = T.token_files(docs, path, 2, 49_408)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.start, r.n_tokens, r.ids_crc32) for r in read.collect())
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "")):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((-1 if r.doc_id is None else r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert sum(r.n_tokens for r in manifest.collect()) == start
    assert T.token_files(spark.createDataFrame([], SCHEMA), path, 2, 49_408)[1].count() == 0


def test_whole_texts_and_wide_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, text = Tokenizer.from_file(path), "Two  words\n and more."
    got = T.token_files(spark.createDataFrame([(1, text)], SCHEMA), path, 70_000, 70_001, word_parts=False)[1].first()
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 70_000]
    assert (got.n_tokens, got.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


# ------------------------------------------------------------------ op4


def best_score(p, text):
    best = [0.0] + [-1e300] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            if text[start:end] in p.score:
                best[end] = max(best[end], best[start] + p.score[text[start:end]][0])
        if text[end - 1] not in p.score:
            best[end] = max(best[end], best[end - 1] + p.unknown)
    return best[-1]


def score(p, ids, text):
    known = {i[0]: s for s, i in p.score.values()}
    return sum(known.get(i, 0.0) for i in ids) + p.unknown * sum(c not in p.score for c in text)


def test_streamed_paths_are_best():
    rnd = random.Random(2)
    small = V.Pieces([(x, -rnd.randrange(72) / 8, 300 + k) for k, x in enumerate(["a", "b", "ab", "ba", "aab", "bab", "abab", "▁", "▁a", "▁▁", "aaaaaa"])], list(range(256)))
    full = V.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for p, letters in ((small, "ab  ▁\nc"), (full, "thea ng\n▁é日. ")):
        for _ in range(400):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 70)))
            ids = p.encode(text).tolist()
            assert p.decode(ids) == text.encode()
            plain = text.replace("▁", "~")
            marked = f" {plain}".replace(" ", "▁")
            assert abs(score(p, p.encode(plain).tolist(), marked) - best_score(p, marked)) < 1e-6 * max(1, abs(best_score(p, marked)))
            assert [i for run in p.stream(marked) for i in run] == p.encode(plain).tolist()


def test_as_many_ids_as_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    p, library = V.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    text = (
        "The quick brown fox jumps over the lazy dog and runs away from the farmer's house. Large tables are read in parts, "
        "and every part is sorted before it is written. In the morning the children walked to school together, talking about "
        "the weather, their holidays and the new teacher who had arrived from another country last week."
    )
    ours, theirs = p.encode(text).tolist(), library.encode(text)
    assert abs(len(ours) - len(theirs)) <= 0.02 * len(theirs) + 1
    assert len(set(ours) & set(theirs)) > 0.9 * len(set(theirs))


def test_ids_are_handed_out_early():
    p = V.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    handed = list(p.stream("abcde" * 4000))
    assert len(handed) > 500 and max(map(len, handed)) < 100


def test_encoding_goes_round(spark):
    path, docs = public_tokenizers.path("piece_bpe_32k.model"), rows(spark)
    assert all(r.round_trip for r in V.encoded_digest(docs, path).collect())
    texts = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert sorted((r.doc_id or -1, r.text) for r in V.decode(V.encode(docs, path), path).collect()) == texts
    assert V.encode(spark.createDataFrame([], SCHEMA), path).count() == 0


# ------------------------------------------------------------------ op5

BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    long = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in p.finditer(text) if long[k](m)]
    return [(s, e, list(BASE)[i]) for s, i, e in sorted(found)]


def test_automaton_finds_what_the_expressions_find():
    rnd = random.Random(5)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "_", ":", "=", " ", '"', "'", "AKIA", "A", "Z9", "0123456789abcdef", "deadbeef", "f", "0", "é", "日", "\n", "x", "abcdefghijkl", ".", "-", "+/", "to", "ghp_", "eyJ", "-----BEGIN ", "PRIVATE KEY-----", "RSA "]
    for _ in range(8000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert [x for x in D.scan(text.encode()) if x[2] in BASE] == secrets(text), text


def test_added_rules():
    for kind, text in (("hub", "ghp_" + "a1B" * 12), ("cloud", "AIza" + "x-Y_9" * 7), ("jwt", "eyJhbGciOiJI.eyJzdWIiOiIxMjM0NTY3ODkw.SflKxw"), ("pem", "-----BEGIN RSA PRIVATE KEY-----"), ("chat", "xoxb-123456789012-abcdefXYZ")):
        assert (2, 2 + len(text), kind) in D.scan(f"é {text} z".encode()), kind


def test_minimised_automaton_is_the_smallest():
    a = D.determinise([D.parse("(a|b)*abb")], search=False)
    assert len([m for i, m in enumerate(a.marks) if i != a.dead]) == 4  # as in the textbook


def test_secrets_of_rows(spark):
    docs = spark.createDataFrame(ODD + [(20, "é token = 'abcdefghijkl0' 0123456789abcdef"), (21, "0" * 20_000)], SCHEMA)
    got = by_id(D.find_secrets(docs))
    for r in docs.collect():
        g, want = got[-1 if r.doc_id is None else r.doc_id], secrets(r.text or "")
        told = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert g.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and g.spans == told
        assert [g.n_assign, g.n_access, g.n_hex] == [sum(x[2] == k for x in want) for k in BASE]
    assert D.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------ op9


def phrases(text):
    """Phrases by their texts, the plain way."""
    seen, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in seen:
            end += 1
        if end <= len(text):
            seen.add(text[at:end])
        at = end
    return seen


def test_phrases_and_fingerprints():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 80)))
        p = L.Parse()
        p.feed(text)
        found = [text[a:b] for a, b in zip(p.ends, p.ends[1:], strict=False)]
        assert set(found) == phrases(text) and len(found) == len(set(found))
    a, b = (" ".join(rnd.choice(["the", "of", "and", "house", "tree", f"x{rnd.randrange(999)}"]) for _ in range(400)) for _ in range(2))
    share = len(phrases(a) & phrases(b)) / len(phrases(a) | phrases(b))
    assert abs(L.likeness(L.fingerprint(a), L.fingerprint(b)) - share) < 0.2 and L.likeness(L.fingerprint(a), L.fingerprint(a)) == 1


def test_neighbours_in_order(spark):
    docs = spark.createDataFrame([x for x in ODD if x != (4, "x")] + [(100 + d, t) for d, t in corpus(4)], SCHEMA)
    got = by_id(L.neighbour_fingerprints(docs))
    ordered = sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    assert len(got) == len(ordered)
    for r, nxt in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        g, text, after = got[-1 if r.doc_id is None else r.doc_id], r.text or "", nxt.text or ""
        q = len(text) // 4
        new = text[: len(text) - q] + after[:q]
        prints = [L.fingerprint(x) for x in (text, new, after)]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == tuple(L.written(x) for x in prints[:2])
        assert (g.near_edited, g.near_next) == (L.likeness(prints[0], prints[1]), L.likeness(prints[0], prints[2]))
    assert L.neighbour_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = L.neighbour_fingerprints(spark.createDataFrame([(5, "abcd")], SCHEMA)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abca").hexdigest()
    assert L.neighbour_fingerprints(spark.createDataFrame([(4, "x"), (4, "x"), (4, "y")], SCHEMA)).count() == 3


# ------------------------------------------------------------------ op3: pieces


def test_plain_runs_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert T.drops_space(path)
    runs, whole, rnd = T.run_ids(path, "<u2"), Tokenizer.from_file(path), random.Random(8)
    letters = "abcXYZ019'.,!?-_<|>#\x7féñßÿÀÖ×÷\xa0日𝒳 "
    words_ = ["don't", "WE'LL", "it's'd", "<|endoftext|>", "a<|startoftext|>b", "Straße", "ÀÉÎ", "é", "ﬁ", "12345", "x" * 90, "'s's", "\x01a"]
    words_ += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    for text in words_:
        for run in text.encode().split():
            want = whole.encode(run.decode(), add_special_tokens=False).ids
            assert np.frombuffer(runs[run], "<u2").tolist() == want, run


def test_kept_values_come_back_after_both_generations():
    made = []
    kept = T.Kept(lambda k: made.append(k) or len(k), most=8)
    for k in [b"a" * n for n in range(1, 30)] * 2:
        assert kept[k] == len(k)
    assert len(kept) <= 4 and len(kept.before) <= 4 and len(made) < 60


# ------------------------------------------------------------------ op9: ranges


def test_fingerprints_at_many_ranges(spark):
    docs = spark.createDataFrame(corpus(4), SCHEMA)
    few = by_id(L.neighbour_fingerprints(docs))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        plan = L.neighbour_fingerprints(docs)
        assert plan.columns and len(plan._jdf.queryExecution().optimizedPlan().toString()) < 2_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert by_id(L.neighbour_fingerprints(docs.repartition(3))) == few
