"""The catalogue of metrics and algorithms: YAML files scanned into rows, look-ups, and execution by group.

Files are read by Spark, so they may lie in any store that it reads; a catalogue has some hundred entries and is a
value of the driver. A metric's own work is a plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.geometry import looked, shared_neighbours
from lumenfold.sources.loaders import metric_spec, variants

GROUPS = ("embedding", "dataset", "module")


def _yaml(text: str):
    try:
        import yaml
    except ImportError:
        return json.loads(text)  # JSON is YAML, too
    return yaml.safe_load(text)


def config_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(path below the folder, text) of its YAML files: those of the folder itself by name, then those of each group's."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    rows = read.select(F.col("_metadata.file_path").alias("path"), "value").collect()
    name = folder.rstrip("/").rpartition("/")[2]
    below = [(r["path"].rpartition(f"/{name}/")[2], r["value"]) for r in rows]
    order = {"": 0} | {g: k for k, g in enumerate(GROUPS, 1)}
    known = [(order[str(PurePosixPath(p).parent).replace(".", "", 1)], p, t) for p, t in below if str(PurePosixPath(p).parent).replace(".", "", 1) in order]
    return [(p, t) for _, p, t in sorted(known)]


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the settings in a folder, sorted."""
    return sorted(PurePosixPath(p).stem for p, _ in config_files(spark, folder))


def scan_metrics(files: Iterable[tuple[str, str]], source: str = "core") -> dict[str, dict]:
    """Entries by name: class, group, defaults, partial, source, source_file.

    A name in several files is that of the file called like it, the last such; else that of the first. The group is the
    entry's `at`, else the folder's, else embedding. Files that can't be read, tests, and entries without a target are
    skipped.
    """
    out: dict[str, dict] = {}
    for path, text in files:
        stem, parent = PurePosixPath(path).stem, PurePosixPath(path).parent.name
        if stem.startswith("test_") or stem == "__init__":
            continue
        try:
            entries = _yaml(text) or {}
        except Exception:  # noqa: BLE001 - one broken file doesn't take the others' entries
            continue
        for name, own in entries.items() if isinstance(entries, dict) else ():
            if not isinstance(own, dict) or not own.get("_target_") or name in out and stem != name:
                continue
            defaults = {k: v for k, v in own.items() if not k.startswith("_") and k != "at"}
            out[name] = {"class": own["_target_"], "group": own.get("at", parent if parent in GROUPS else None) or "embedding", "defaults": defaults, "partial": own.get("_partial_", True), "source": source, "source_file": path}
    return out


def scan_algorithms(files: Iterable[tuple[str, str]], source: str = "core") -> dict[str, dict]:
    """Entries by the file's name in capitals; parameters that refer to other settings are no defaults."""
    out: dict[str, dict] = {}
    for path, text in files:
        stem = PurePosixPath(path).stem
        try:
            own = _yaml(text)
        except Exception:  # noqa: BLE001 - as above
            continue
        if stem.startswith("test_") or not isinstance(own, dict) or not own.get("_target_"):
            continue
        defaults = {k: v for k, v in own.items() if not k.startswith("_") and "${" not in str(v)}
        out[stem.upper()] = {"class": own["_target_"], "defaults": defaults, "source": source, "source_file": path}
    return out


@dataclass
class Catalogue:
    """Metrics and algorithms by name; extensions override the core's metrics of the same name."""

    metrics: dict[str, dict]
    algorithms: dict[str, dict] = field(default_factory=dict)
    version: str = "unknown"

    @classmethod
    def scan(cls, spark: SparkSession, folder: str, extensions: Sequence[tuple[str, str]] = (), version: str = "unknown", cache: str | None = None) -> Catalogue:
        """folder: metrics in `metrics`, algorithms in `algorithms/latent`. extensions: (name, folder of metrics).

        cache: a folder that keeps the catalogue as JSON; one of the same version that has metrics is not scanned again.
        """
        if cache and (kept := cls.read(spark, cache)) and kept.version == version and kept.metrics:
            return kept
        found = cls(scan_metrics(config_files(spark, f"{folder}/metrics")), {}, version)
        try:
            found.algorithms = scan_algorithms(config_files(spark, f"{folder}/algorithms/latent"))
        except Exception as error:  # noqa: BLE001 - a catalogue may have no algorithms
            if "PATH_NOT_FOUND" not in str(error):
                raise
        for name, own in extensions:
            found.metrics |= scan_metrics(config_files(spark, own), name)
        if cache:
            spark.createDataFrame([(json.dumps({"version": version, "metrics": found.metrics, "algorithms": found.algorithms}),)], "value string").coalesce(1).write.mode("overwrite").text(cache)
        return found

    @classmethod
    def read(cls, spark: SparkSession, cache: str) -> Catalogue | None:
        try:
            kept = json.loads(spark.read.text(cache, wholetext=True).first()["value"])
            return cls(kept["metrics"], kept["algorithms"], kept["version"])
        except Exception:  # noqa: BLE001 - a cache that can't be read is made anew
            return None

    def names(self, group: str | None = None) -> list[str]:
        return [n for n, own in self.metrics.items() if group in (None, own["group"])]

    def info(self, name: str, kind: str = "metrics") -> dict:
        known = getattr(self, kind)
        if name not in known:
            raise KeyError(f"no {kind[:-1]} {name!r}; available: {sorted(known)[:10]}")
        return known[name]

    def counts(self) -> dict[str, dict[str, int]]:
        """How many metrics each group and each source has."""
        out: dict[str, dict[str, int]] = {"group": dict.fromkeys(GROUPS, 0), "source": {}}
        for own in self.metrics.values():
            for kind in out:
                out[kind][own[kind]] = out[kind].get(own[kind], 0) + 1
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, m["class"], m["group"], json.dumps(m["defaults"], sort_keys=True), m["partial"], m["source"], m["source_file"]) for n, m in self.metrics.items()]
        return spark.createDataFrame(rows, "name string, class string, group string, defaults string, partial boolean, source string, source_file string")


#: A metric's plan by its class: (frame, parameters) -> a frame with one row, `value`.
IMPLEMENTED: dict[str, Callable[..., DataFrame]] = {}


def implements(path: str):
    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        IMPLEMENTED[path] = fn
        return fn

    return keep


def set_up(catalogue: Catalogue, specs: Sequence[str | dict], **everywhere) -> dict[str, dict]:
    """Metrics ready to run, by name of the variant: defaults, then what holds everywhere, then the metric's own."""
    out: dict[str, dict] = {}
    for spec in specs:
        name, own = metric_spec(spec)
        info = catalogue.info(name)
        if info["class"] not in IMPLEMENTED:
            raise ImportError(f"nothing implements {info['class']}")
        for variant, params in variants(name, info["defaults"] | everywhere | own):
            out[variant] = {"run": IMPLEMENTED[info["class"]], "group": info["group"], "params": params}
    return out


def execute(spark: SparkSession, ready: dict[str, dict], **frames: DataFrame | None) -> DataFrame:
    """metric, score, error: each metric on the frame of its group (embedding=, dataset=, module=).

    A metric whose group has no frame, or that no one knows, is left out; one that fails has no score, and its error.
    """
    rows, near = [], {}
    for group, given in frames.items():
        if given is not None and {"id", "state"} <= set(given.columns):
            users = [own for own in ready.values() if own["group"] == group]
            near[group] = shared_neighbours(given, [own["run"] for own in users], [own["params"] for own in users])
    for name, own in ready.items():
        given = frames.get(own["group"]) if own["group"] in GROUPS else None
        if given is None:
            continue
        try:
            shared = {"near": near[own["group"]]} if near.get(own["group"]) is not None and looked(own["run"]) else {}
            value = own["run"](given, **own["params"], **shared).select(F.col("value").cast("double")).first()
            rows.append((name, None if value is None else value[0], None))
        except Exception as error:  # noqa: BLE001 - any metric may fail, and the others stand
            rows.append((name, None, f"{type(error).__name__}: {error}"[:500]))
    return spark.createDataFrame(rows, "metric string, score double, error string")
