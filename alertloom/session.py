"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings: duplicate JSON keys resolve to the last one, times are UTC.
RUNTIME_SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that the operators' results depend on."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    ``fallback`` is used only where the session names none, as in tests; a
    cluster job without a shared folder fails here instead of writing to a
    machine-local path.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if fallback:
        return fallback
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")
