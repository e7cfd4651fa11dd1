"""Per-system presets: log formats, masking rules and build parameters.

Everything here is driver-side configuration. Operators receive presets as
plain Python values (or as a small DataFrame built from them) and lower them
to Column expressions; nothing in here touches data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the published per-system settings for results to
# be comparable. Listed as text, in the order the systems are usually given.
#
# name: (log format, masking regexes, dist, tau, n_clusters or None, alpha)
# ---------------------------------------------------------------------------
_PRESET_TABLE: dict[str, tuple[str, list[str], float, float, int | None, float]] = {
    "HDFS": ("<Date> <Time> <Pid> <Level> <Component>: <Content>",
             [r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?"],
             0.700, 0.10, None, 0.7),
    "Hadoop": (r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>",
               [r"(\d+\.){3}\d+"],
               0.650, 0.10, None, 0.7),
    "Spark": ("<Date> <Time> <Level> <Component>: <Content>",
              [r"(\d+\.){3}\d+", r"\b[KGTM]?B\b", r"([\w-]+\.){2,}[\w-]+"],
              0.970, 0.85, 36, 0.7),
    "Zookeeper": (r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>",
                  [r"(/|)(\d+\.){3}\d+(:\d+)?"],
                  0.640, 0.90, None, 0.7),
    "BGL": ("<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>",
            [r"core\.\d+"],
            0.820, 0.70, None, 0.7),
    "HPC": ("<LogId> <Node> <Component> <State> <Time> <Flag> <Content>",
            [r"=\d+"],
            0.990, 0.80, 46, 0.7),
    "Thunderbird": (r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
                    [r"(\d+\.){3}\d+"],
                    0.790, 0.61, 149, 0.7),
    "Windows": ("<Date> <Time>, <Level>                  <Component>    <Content>",
                [r"0x.*?\s"],
                0.600, 0.70, 50, 0.7),
    "Linux": (r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
              [r"(\d+\.){3}\d+", r"\d{2}:\d{2}:\d{2}"],
              0.350, 0.65, 72, 0.7),
    "Android": ("<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
                [r"(/[\w-]+)+", r"([\w-]+\.){2,}[\w-]+",
                 r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b"],
                0.420, 0.80, None, 0.7),
    "HealthApp": (r"<Time>\|<Component>\|<Pid>\|<Content>",
                  [],
                  0.870, 0.10, 75, 0.2),
    "Apache": (r"\[<Time>\] \[<Level>\] <Content>",
               [r"(\d+\.){3}\d+"],
               0.960, 0.70, 6, 0.3),
    "Proxifier": (r"\[<Time>\] <Program> - <Content>",
                  [r"<\d+\s?sec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"],
                  0.750, 0.95, 8, 0.7),
    "OpenSSH": (r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>",
                [r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+"],
                0.995, 0.75, 15, 0.7),
    "OpenStack": (r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>",
                  [r"((\d+\.){3}\d+,?)+", r"/.+?\s", r"\d+"],
                  0.990, 0.90, None, 0.7),
    "Mac": (r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>",
            [r"([\w-]+\.){2,}[\w-]+"],
            0.569, 0.78, None, 0.7),
}

# Defaults for a system without a preset (build parameters and alpha).
DEFAULT_DIST, DEFAULT_TAU, DEFAULT_ALPHA = 0.70, 0.50, 0.5

# Match-class cut points and online parameters (fixed values).
EXACT_THR, PARTIAL_THR, NEW_THR = 0.99, 0.80, 0.60
TOP_K = 3
STORE_CAPACITY, COMPACT_SIM = 5000, 0.98
VOTE_FLOOR = 0.35
CUT_FACTORS = (0.5, 0.7, 0.85, 1.0, 1.1)          # two-stage cut multipliers
SINGLE_STAGE_FACTORS = (0.7, 0.85, 1.0, 1.1)      # no-keyword ablation
CUT_CLAMP = (0.05, 0.99)
SPLIT_RATIO = 0.70
ENTROPY = dict(base=0.20, window=500, low=0.30, high=0.80, step=0.01,
               min_t=0.05, max_t=0.55, interval=100, min_entries=10, buckets=10000)
# The grids of the sweeps.
ALPHA_GRID = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
TAU_R_GRID = (0.10, 0.30, 0.50, 0.70, 0.90)
TAU_D_DELTAS = (-0.20, -0.10, 0.00, 0.10, 0.20)
LCS_THR = 0.5

# Header patterns for lines of an unknown system, tried in this order.
UNKNOWN_HEADER_PATTERNS = (
    r"^\S+\s+\S+\s+\w+\s+[:\w\.]+:\s*(.*)",
    r"^\S+\s+\S+\s+\w+\s+(.*)",
    r"^\w+/\d+\s+\S+\s+\w+\s+[:\.\w]+\s+(.*)",
)
# Generic masks for an unknown system, applied in this order.
UNKNOWN_MASKS = (
    (r"(\d{1,3}\.){3}\d{1,3}(:\d+)?", "<IP>"),
    (r"\b\d+\b", "<NUM>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
)
# Fixed value: timestamped line, `yyyy-MM-dd HH:mm:ss,ms LEVEL logger: message`.
TIMESTAMPED_LINE = r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2},\d+\s+\w+\s+[\w.$]+:\s*(.*)$"


@dataclass(frozen=True)
class Preset:
    name: str
    log_format: str | None
    regexes: tuple[str, ...] = field(default_factory=tuple)
    dist: float = DEFAULT_DIST
    tau: float = DEFAULT_TAU
    n_clusters: int | None = None
    alpha: float = DEFAULT_ALPHA


def preset(name: str) -> Preset:
    """Preset by system name; unknown names get the defaults and no format."""
    if name in _PRESET_TABLE:
        fmt, rex, dist, tau, k, alpha = _PRESET_TABLE[name]
        return Preset(name, fmt, tuple(rex), dist, tau, k, alpha)
    return Preset(name, None)


def preset_names() -> list[str]:
    return list(_PRESET_TABLE)


def params_frame(spark, names=None):
    """Build parameters as a tiny DataFrame `(dataset, dist, tau, n_clusters, alpha)`.

    Joined (broadcast — its size is the number of presets) onto data keyed by
    dataset, so one plan can carry different parameters per system.
    """
    rows = []
    for n in (names or preset_names()):
        p = preset(n)
        rows.append((n, float(p.dist), float(p.tau), p.n_clusters, float(p.alpha)))
    return spark.createDataFrame(
        rows, "dataset string, dist double, tau double, n_clusters int, alpha double")
