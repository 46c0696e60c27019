"""Settings shared by the operators.

Every default can be overridden per call; nothing here is read from the environment.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------------
# Numbers, names and formats that results depend on.

MEASUREMENTS = ("bt", "bz_gsm", "speed", "density", "dst")
FEATURES = ("bt", "bz_gsm", "speed", "density")
BASELINE_FEATURES = ("bz_gsm", "speed", "density")
TARGET = "storm_severity_index"
REQUIRED_COLUMNS = ("datetime", "bt", "bz_gsm", "speed", "density", "dst")

# Half-open, zero-based byte ranges of the yearly fixed-width files.
FIXED_WIDTH_FIELDS = {
    "year": (0, 4),
    "doy": (4, 8),
    "hour": (8, 11),
    "bt": (36, 42),
    "bz_gsm": (78, 84),
    "density": (123, 129),
    "speed": (129, 135),
    "dst": (225, 231),
}

# Fill numbers that stand for "no measurement".
SENTINELS = (
    9999.0, 999.9, 999.99, 999999.0, 99999.0, 99.0, 9.9, -999.9,
    9999999.0, 999999.99, 9.999,
)

# Rows outside these bounds are removed before modelling.
CONDITIONING_LIMITS = {
    "bt": (0.0, 5.0),
    "bz_gsm": (-50.0, 50.0),
    "speed": (200.0, 1200.0),
    "density": (0.1, 200.0),
    "dst": (-500.0, 100.0),
}

# Values outside these bounds are reported, not removed.
REPORT_LIMITS = {
    "bt": (0.0, 50.0),
    "bz_gsm": (-100.0, 100.0),
    "speed": (200.0, 2000.0),
    "density": (0.0, 100.0),
    "dst": (-500.0, 100.0),
}

# Min-max ranges of the five severity components.
NORM_RANGES = {
    "dst": (0.0, 300.0),
    "bz_gsm": (0.0, 20.0),
    "bt": (0.0, 30.0),
    "speed": (300.0, 800.0),
    "density": (1.0, 50.0),
}

# Component weights, in the order dst, bz, bt, speed, density.
INDEX_WEIGHTS = (0.35, 0.25, 0.20, 0.10, 0.10)
DERIVED_WEIGHTS = (0.30, 0.25, 0.20, 0.15, 0.10)

# Right-closed upper edges of the severity classes; the first bin also holds 0.
CLASS_EDGES = (
    ("quiet", 0.15),
    ("minor", 0.30),
    ("moderate", 0.50),
    ("severe", 0.75),
    ("extreme", 1.0),
)

# Latitude proxy: base minus span times the index, kept inside the bounds.
LATITUDE_BASE = 67.0
LATITUDE_SPAN = 22.0
LATITUDE_BOUNDS = (45.0, 67.0)

# Longest step between neighbours, in hours, that is not a gap.
MAX_STEP_HOURS = 1.0

# What the summary of a prepared table must hold.
GATE_COLUMNS = (
    "train_samples", "val_samples", "test_samples", "sequence_length",
    "n_features", "feature_names", "target_name",
)

# Smallest sequence counts accepted for training.
MIN_SEQUENCES = {"train": 1000, "val": 200, "test": 200}
# ------------------------------------------------------------------------------------

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class SeriesOrder:
    """How rows are ordered: by ``time``, ties by ``tiebreak``, inside each series of ``by``.

    ``tiebreak`` must be an integral column that is unique among rows of equal time, so
    that the order is total. With ``by`` empty all rows form one series.
    """

    time: str = "datetime"
    tiebreak: str = "event_id"
    by: tuple[str, ...] = ()

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.by, self.time, self.tiebreak)


@dataclass(frozen=True)
class ForestSettings:
    """``partitions`` is how many parts the rows are dealt to; what each tree samples depends on it."""

    partitions: int = 16
    trees: int = 100
    depth: int = 10
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    window: int = 24
    val_fraction: float = 0.15
    test_fraction: float = 0.15
    features: tuple[str, ...] = FEATURES
    target: str = TARGET
    weights: tuple[float, ...] = DERIVED_WEIGHTS
    limits: dict = field(default_factory=lambda: dict(CONDITIONING_LIMITS))
