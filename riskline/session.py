"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "riskline") -> SparkSession:
    """A local session configured like the cluster one (AQE on, UTC, Arrow, no UI)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("RISKLINE_DRIVER_MEMORY", "8g"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder; only when the session names none (tests) pick one."""
    d = checkpoint_dir(spark)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="riskline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local one on a cluster)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/riskline/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``riskline`` importable on executors (pandas UDFs pickle references to
    its classes): zip the package once per application and ``addPyFile`` it.

    The zip goes to the session's checkpoint folder when that is a local path
    (tests), otherwise to the driver's temp folder — Spark's file server copies it
    to every executor either way."""
    sc = spark.sparkContext
    with _SHIPPING:
        if sc.applicationId not in _SHIPPED:
            _ship(sc, checkpoint_dir(spark) or "")
            _SHIPPED.add(sc.applicationId)


def _ship(sc, ck: str) -> None:
    import hashlib
    import io
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"riskline/{p.relative_to(root)}")
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:12]
    local = ck.startswith("file:") or (ck and "://" not in ck)
    folder = Path(ck.replace("file://", "").replace("file:", "")) if local else Path(tempfile.gettempdir())
    folder = folder / "riskline-pkg"
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"riskline-{digest}.zip"
    if not target.exists():
        target.write_bytes(data)
    sc.addPyFile(str(target))
