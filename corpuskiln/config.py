"""Settings from the environment and the choice of a folder of knowledge files."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import SparkSession

from corpuskiln import storage

#: The statute's file, profiles that come first, and words for true (fixed values).
STATUTE_FILE = "usc26.xml"
PREFERRED_PROFILES = ("2017", "2024-2026")
TRUE_WORDS = frozenset(("1", "true", "yes", "on"))


def flag(name: str, default: bool, env: Mapping[str, str] = os.environ) -> bool:
    """A setting that is on for 1, true, yes or on, case and blanks aside."""
    return default if name not in env else env[name].strip().lower() in TRUE_WORDS


def whole_number(name: str, default: int, env: Mapping[str, str] = os.environ) -> int:
    """A setting that is a whole number; the default for anything else."""
    said = env.get(name, "").strip()
    return int(said) if re.fullmatch(r"[+-]?\d+(?:_\d+)*", said) else default


def slug(name: str) -> str:
    """A name for files: lower case, spaces as hyphens, letters, digits, hyphens and underscores only; "default" if nothing is left."""
    kept = re.sub(r"[^\w-]", "", name.strip().lower().replace(" ", "-"))
    return kept or "default"


def profile_folder(spark: SparkSession, root: str, profile: str = "") -> str:
    """The folder to read: the named profile (an error if there is none), else the root if the statute lies in it, else the first profile with a statute, preferred ones before others; else the root."""
    if profile := profile.strip():
        if not storage.exists(spark, f"{root}/{profile}"):
            raise FileNotFoundError(f"no profile {profile!r} under {root}")
        return f"{root}/{profile}"
    options = [root, *(f"{root}/{p}" for p in PREFERRED_PROFILES), *(f"{root}/{n}" for n in storage.names(spark, root))]
    return next((o for o in options if storage.exists(spark, f"{o}/{STATUTE_FILE}")), root)
