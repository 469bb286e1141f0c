"""Settings of an engine from the environment.

Names are ``FORKLINE__SECTION__KEY``: ``FORKLINE__WAREHOUSE__ROOT``, ``FORKLINE__CHUNKER__TYPE`` (``fixed`` or ``cdc``),
``FORKLINE__CHUNKER__CHUNK_SIZE_BYTES``, ``FORKLINE__CHUNKER__MIN_BYTES``, ``..__AVG_BYTES``, ``..__MAX_BYTES``, and for an S3 store
``FORKLINE__STORAGE__ENDPOINT``, ``..__REGION``, ``..__ACCESS_KEY``, ``..__SECRET_KEY``.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from forkline.chunking import DEFAULT_CHUNK_SIZE, Chunker, ContentDefined, FixedSize
from forkline.errors import InvalidInput
from forkline.sources import is_local

PREFIX = "FORKLINE__"


@dataclass(frozen=True)
class Settings:
    root: str = "./forkline-warehouse"
    chunker: Chunker = field(default_factory=FixedSize)
    #: Hadoop options for the session, of an S3-compatible store
    storage: dict[str, str] = field(default_factory=dict)


def _number(env: Mapping[str, str], name: str, default: int | None = None) -> int:
    value = env.get(PREFIX + name)
    if value is None and default is None:
        raise InvalidInput(f"{PREFIX}{name} must be set")
    try:
        return default if value is None else int(value)
    except ValueError as e:
        raise InvalidInput(f"{PREFIX}{name} must be a whole number") from e


def s3_options(env: Mapping[str, str]) -> dict[str, str]:
    """Options of Spark's S3 file system; with an endpoint, bucket names go into the path."""
    names = {"ENDPOINT": "endpoint", "REGION": "endpoint.region", "ACCESS_KEY": "access.key", "SECRET_KEY": "secret.key"}
    out = {f"spark.hadoop.fs.s3a.{to}": env[f"{PREFIX}STORAGE__{key}"] for key, to in names.items() if f"{PREFIX}STORAGE__{key}" in env}
    return out | ({"spark.hadoop.fs.s3a.path.style.access": "true"} if f"{PREFIX}STORAGE__ENDPOINT" in env else {})


def settings(env: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if env is None else env
    kind = env.get(f"{PREFIX}CHUNKER__TYPE", "fixed")
    if kind == "fixed":
        chunker: Chunker = FixedSize(_number(env, "CHUNKER__CHUNK_SIZE_BYTES", DEFAULT_CHUNK_SIZE))
    elif kind == "cdc":
        chunker = ContentDefined(*(_number(env, f"CHUNKER__{x}_BYTES") for x in ("MIN", "AVG", "MAX")))
    else:
        raise InvalidInput(f"{PREFIX}CHUNKER__TYPE must be fixed or cdc")
    return Settings(env.get(f"{PREFIX}WAREHOUSE__ROOT", Settings.root), chunker, s3_options(env))


def engine(spark: SparkSession, env: Mapping[str, str] | None = None):
    """An engine as the environment says; storage options belong into the session before it starts."""
    from forkline.api import Engine

    s = settings(env)
    if s.root == Settings.root and not is_local(spark):
        raise InvalidInput(f"{PREFIX}WAREHOUSE__ROOT must be set on a cluster")
    return Engine(spark, s.root, chunker=s.chunker)
