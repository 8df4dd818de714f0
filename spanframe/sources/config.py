"""Experiment configurations: a flat table of known settings with type, default and range; seeds become runs.

A file is YAML; its nesting is flattened to dotted names, checked against the table, and completed. Nothing is executed: configurations
are rows of the run registry.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from spanframe.sources.files import exists, write_file
from spanframe.sources.runs import canonical_json, data_digest, run_id

REQUIRED = object()


class ConfigError(ValueError):
    """A configuration is wrong; the message names the file and the setting."""


@dataclass(frozen=True)
class Known:
    kind: Callable[[Any], Any]
    default: Any
    holds: Callable[[Any], bool] = lambda v: True
    says: str = ""


def _whole(v: Any) -> int:
    if isinstance(v, bool) or float(v) != int(float(v)):
        raise ValueError
    return int(float(v))


def _flag(v: Any) -> bool:
    if not isinstance(v, bool):
        raise ValueError
    return v


def _text(v: Any) -> str:
    if not isinstance(v, str):
        raise ValueError
    return v


def _numbers(v: Any) -> list[int]:
    return [_whole(x) for x in (v if isinstance(v, list) else [v])]


_ABOVE = (lambda v: v > 0, "above 0")
#: Settings of an experiment (names and defaults are fixed values).
SETTINGS: dict[str, Known] = {
    "name": Known(_text, REQUIRED),
    "seeds": Known(_numbers, [42], lambda v: v and len(set(v)) == len(v), "distinct, one at least"),
    "output_root": Known(_text, "runs"),
    "data.dir": Known(_text, REQUIRED),
    "data.train_fraction": Known(float, 1.0, lambda v: 0 < v <= 1, "in (0, 1]"),
    "data.subsample_seed": Known(_whole, 42),
    "data.max_train_samples": Known(_whole, None, *_ABOVE),
    "model.name": Known(_text, "bert-base-multilingual-cased"),
    "model.max_len": Known(_whole, 128, lambda v: v > 2, "above 2"),
    "model.add_prefix_space": Known(_flag, None),
    "model.revision": Known(_text, None),
    "model.head_mapping": Known(_text, None),
    "method.name": Known(_text, "full", lambda v: v in ("full", "frozen", "lora"), "full, frozen or lora"),
    "method.lora.r": Known(_whole, 8, *_ABOVE),
    "method.lora.alpha": Known(_whole, 16, *_ABOVE),
    "method.lora.dropout": Known(float, 0.1, lambda v: 0 <= v < 1, "in [0, 1)"),
    "training.learning_rate": Known(float, 5e-5, *_ABOVE),
    "training.epochs": Known(float, 3.0, *_ABOVE),
    "training.train_batch_size": Known(_whole, 4, *_ABOVE),
    "training.eval_batch_size": Known(_whole, 8, *_ABOVE),
    "training.grad_accumulation": Known(_whole, 2, *_ABOVE),
    "training.weight_decay": Known(float, 0.01, lambda v: v >= 0, "0 or above"),
}
#: Settings of a pre-training run (names and defaults are fixed values).
PRETRAINING: dict[str, Known] = {
    "name": Known(_text, REQUIRED),
    "seed": Known(_whole, 42),
    "output_root": Known(_text, "../models"),
    "corpus.path": Known(_text, REQUIRED),
    "corpus.max_chunks": Known(_whole, None, *_ABOVE),
    **{f"{part}.{name}": SETTINGS[f"model.{name}"] for part in ("model", "chunker") for name in ("name", "max_len", "add_prefix_space", "revision")},
    "masking.probability": Known(float, 0.15, lambda v: 0 < v < 1, "in (0, 1)"),
    "masking.mask_share": Known(float, 0.8, lambda v: v >= 0, "0 or above"),
    "masking.random_share": Known(float, 0.1, lambda v: v >= 0, "0 or above"),
    "training.learning_rate": Known(float, 5e-5, *_ABOVE),
    "training.epochs": Known(float, 1.0, *_ABOVE),
    "training.train_batch_size": Known(_whole, 8, *_ABOVE),
    "training.grad_accumulation": Known(_whole, 4, *_ABOVE),
    "training.weight_decay": Known(float, 0.01, lambda v: v >= 0, "0 or above"),
    "training.warmup": Known(float, 0.05, lambda v: 0 <= v < 1, "in [0, 1)"),
    "training.fp16": Known(lambda v: str(v).lower() if isinstance(v, bool) else _text(v), "auto", lambda v: v in ("auto", "true", "false"), "auto, true or false"),
    "training.logging_steps": Known(_whole, 100, *_ABOVE),
    "training.save_steps": Known(_whole, 2000, *_ABOVE),
}
#: Settings that say where things lie, not what is computed.
PLACES = ("name", "output_root", "data.dir", "seeds", "corpus.path")


def flatten(nested: dict, prefix: str = "", settings: dict[str, Known] = SETTINGS) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in nested.items():
        path = f"{prefix}{key}"
        if isinstance(value, dict) and path not in settings:
            out |= flatten(value, path + ".", settings)
        else:
            out[path] = value
    return out


def checked(nested: dict, where: str = "configuration", settings: dict[str, Known] = SETTINGS) -> dict[str, Any]:
    """All settings by dotted name, completed by defaults; numbers may be written as text (``5e-5``).

    Unknown names, with the nearest known one, missing names, and values of the wrong kind or range are errors.
    """
    given = flatten(nested or {}, settings=settings)
    for name in given:
        if name not in settings:
            near = difflib.get_close_matches(name, settings, 1)
            raise ConfigError(f"{where}: unknown setting {name!r}" + (f"; is {near[0]!r} meant?" if near else ""))
    out: dict[str, Any] = {}
    for name, known in settings.items():
        value = given.get(name, known.default)
        if value is REQUIRED:
            raise ConfigError(f"{where}: {name!r} is missing")
        if value is not None:
            try:
                value = known.kind(value)
            except (TypeError, ValueError):
                raise ConfigError(f"{where}: {name!r} can't be {value!r}") from None
            if not known.holds(value):
                raise ConfigError(f"{where}: {name!r} must be {known.says}, not {value!r}")
        out[name] = value
    return out


def _read(path: str, settings: dict[str, Known]) -> dict[str, Any]:
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if data is not None and not isinstance(data, dict):
        raise ConfigError(f"{path}: a mapping of settings is needed")
    return checked(data, path, settings)


def read_config(path: str) -> dict[str, Any]:
    return _read(path, SETTINGS)


def read_pretraining(path: str) -> dict[str, Any]:
    """The settings of a pre-training run: chunks, masks, training. Shares of masking must leave room; a revision belongs to a named model, not to a folder."""
    found = _read(path, PRETRAINING)
    if found["masking.mask_share"] + found["masking.random_share"] > 1:
        raise ConfigError(f"{path}: 'masking.mask_share' and 'masking.random_share' must not exceed 1 together")
    for part in ("model", "chunker"):
        if found[f"{part}.revision"] is not None and is_local(found[f"{part}.name"]):
            raise ConfigError(f"{path}: '{part}.revision' needs a named model, {found[f'{part}.name']!r} is a folder")
    return found


def expand(settings: dict[str, Any], **identity: str | None) -> list[dict[str, Any]]:
    """One run per seed, with its id: a digest of what is computed (settings but places), the seed, and the identities given."""
    core = {k: v for k, v in settings.items() if k not in PLACES and v is not None}
    return [{**settings, "seed": seed, "run_id": run_id(core | {"seed": seed}, **identity)} for seed in settings["seeds"]]


def registry_rows(spark: SparkSession, runs: list[dict[str, Any]]) -> DataFrame:
    """``run_id, name, seed, config`` (canonical JSON) of expanded runs."""
    return spark.createDataFrame([(r["run_id"], r["name"], r["seed"], canonical_json({k: v for k, v in r.items() if k not in ("run_id", "seeds")})) for r in runs], "run_id string, name string, seed long, config string")


def pending(spark: SparkSession, runs: list[dict[str, Any]], folder: str, force: bool = False) -> list[dict[str, Any]]:
    """The runs without metrics in ``folder``: completed ids are skipped unless ``force``, started ones are made again."""
    return [r for r in runs if force or not exists(spark, f"{folder}/{r['run_id']}/metrics.json")]


def results(spark: SparkSession, run: dict[str, Any], folder: str, make: Callable[[dict[str, Any]], dict], force: bool = False) -> dict:
    """The metrics of a run: those in ``folder`` if it is completed, else what ``make`` gives, which is then kept. The file is published last and at once."""
    path = f"{folder}/{run['run_id']}/metrics.json"
    if pending(spark, [run], folder, force):
        write_file(spark, f"{folder}/{run['run_id']}/config.json", canonical_json({k: v for k, v in run.items() if k != "seeds"}) + "\n")
        write_file(spark, path, json.dumps(make(run), indent=2, ensure_ascii=False) + "\n")
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def file_digest(path: str) -> str:
    """SHA-256 of a file, CRLF as LF: the same content is the same on every system."""
    return hashlib.sha256(Path(path).read_bytes().replace(b"\r\n", b"\n")).hexdigest()


#: Files whose line ends don't count (fixed values).
TEXT_SUFFIXES = (".json", ".txt", ".yaml", ".yml", ".md", ".py", ".csv")


def folder_digest(path: str, names: list[str] | None = None) -> str:
    """One digest of a folder's files by name and content: those named, or all that no dot hides. The same content elsewhere has the same digest.

    For data sets (their split files), model folders and extra test files; line ends of text files count as LF. A folder that isn't there is an error.
    """
    root = Path(path)
    if not root.is_dir():
        raise ConfigError(f"{path} is no folder")
    files = [root / n for n in names] if names else [p for p in root.rglob("*") if p.is_file() and not any(part.startswith(".") for part in p.relative_to(root).parts)]
    return data_digest({p.relative_to(root).as_posix(): (file_digest(str(p)) if p.suffix in TEXT_SUFFIXES else _bytes_digest(p)) for p in files})


def _bytes_digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def code_identity(folder: str | None = None) -> dict[str, Any]:
    """What code runs: the version control's tree of the package with its commit and whether it was changed, or the version where there is none."""
    import spanframe

    package = Path(folder) if folder else Path(spanframe.__file__).parent

    def ask(*words: str) -> str:
        return subprocess.run(["git", "-C", str(package), *words], capture_output=True, text=True, check=True).stdout.strip()

    try:
        place = ask("rev-parse", "--show-prefix").rstrip("/")
        tree = ask("rev-parse", f"HEAD:{place}" if place else "HEAD^{tree}")
        return {"code_ref": tree, "commit": ask("rev-parse", "HEAD"), "changed": bool(ask("status", "--porcelain", "--", "."))}
    except (OSError, subprocess.CalledProcessError):
        return {"code_ref": f"spanframe=={spanframe.__version__}", "commit": None, "changed": None}


def is_local(model: str) -> bool:
    """Whether a model's name is a path (starts with ``/``, ``~``, ``./`` or ``../``, or is a folder here)."""
    return model.startswith(("/", "~", "./", "../")) or Path(model).is_dir()


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions and the settings that matter for reruns."""
    import platform

    conf = spark.conf
    return {"python": platform.python_version(), "spark": spark.version} | {k: conf.get(k, "") for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled")}
