"""Where layers are, and who may write to them: resolution of roots, locks, and the scaffold of a new layer."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

from quillmesh.operators.incremental import _fs, read_text, write_once


class FeatureDisabled(RuntimeError):
    """What was asked for needs a table or setting that is not there."""


def resolve_layers(spark: SparkSession, root: str | None = None, project: str | None = None, start: str | None = None, env: Mapping[str, str] | None = None, marker: str = ".pages", default: str = "~/.pages") -> list[tuple[str, str]]:
    """(layer, root) in the order global, project.

    The global root is the one given, else QUILLMESH_ROOT, else the default.
    The project root is the one given, else QUILLMESH_PROJECT, else the first
    folder named ``marker`` from ``start`` upward; without any there is no
    project layer.
    """
    env = os.environ if env is None else env
    out = [("global", root or env.get("QUILLMESH_ROOT") or os.path.expanduser(default))]
    at = project or env.get("QUILLMESH_PROJECT")
    here = start
    while not at and here:
        fs, p = _fs(spark, f"{here.rstrip('/')}/{marker}")
        if fs.exists(p):
            at = p.toString()
            break
        parent = _fs(spark, here)[1].getParent()
        here = parent.toString() if parent is not None else None
    return out + ([("project", at)] if at and at != out[0][1] else [])


@contextmanager
def locked(spark: SparkSession, roots: list[str]) -> Iterator[None]:
    """Hold the writer's lock of each root, in order; if one is held by another, those taken are given back and it fails at once."""
    taken = []
    try:
        for r in roots:
            fs, p = _fs(spark, f"{r.rstrip('/')}/.lock")
            try:
                fs.mkdirs(p.getParent())
                fs.create(p, False).close()
            except Exception as e:  # a Java error: the file is there
                raise BlockingIOError(f"another writer holds {r}") from e
            taken.append((fs, p))
        yield
    finally:
        for fs, p in reversed(taken):
            fs.delete(p, False)


def init(spark: SparkSession, root: str, topics: list[str]) -> list[str]:
    """Make the configuration and the folders of the topics, where they are not there; what was made."""
    made = []
    fs, p = _fs(spark, f"{root}/config.yaml")
    if not fs.exists(p):
        write_once(spark, p.toString(), "version: 1\ntopics:\n" + "".join(f"  - name: {t}\n" for t in topics))
        made.append("config.yaml")
    for t in topics:
        fs, p = _fs(spark, f"{root}/topics/{t}/pages")
        if not fs.exists(p):
            fs.mkdirs(p)
            made.append(f"topics/{t}")
    return made


def new_page(spark: SparkSession, root: str, ref: str, title: str, day: str, topics: list[str], types: list[str]) -> str:
    """Write the file of a new page and give its path; nothing is written if the topic, type or name does not do."""
    import re

    from quillmesh.functions.frontmatter import dump_scalar

    if not re.fullmatch(r"[a-z0-9-]+/[a-z0-9-]+/[a-z0-9-]+", ref):
        raise ValueError(f"ref-format: {ref}")
    topic, kind, slug = ref.split("/")
    if topic not in topics:
        raise ValueError(f"topic-undefined: {topic}")
    if kind not in types:
        raise ValueError(f"type-undefined: {kind}")
    at = f"{root}/topics/{topic}/pages/{kind}/{slug}.md"
    fs, p = _fs(spark, at)
    if fs.exists(p):
        raise FileExistsError(f"ref-exists: {ref}")
    write_once(spark, at, f"---\ntitle: {dump_scalar(title)}\ntype: {kind}\nslug: {slug}\nupdated: {day}\n---\n\n")
    return at


def load_layer_config(spark: SparkSession, root: str, topics: list[str] | None = None):
    """The configuration of a layer. A layer without one, one that is wrong, and topics that it does not have are errors."""
    from quillmesh.operators.build import load_config

    fs, p = _fs(spark, f"{root.rstrip('/')}/config.yaml")
    if not fs.exists(p):
        raise FileNotFoundError(f"config-schema: no configuration below {root}")
    config, wrong = load_config(read_text(spark, p.toString()))
    if wrong:
        raise ValueError("config-schema: " + "; ".join(wrong))
    unknown = [t for t in topics or [] if t not in config.topics]
    if unknown:
        raise ValueError(f"unknown topics: {', '.join(unknown)}")
    if topics:
        config.topics = [t for t in config.topics if t in topics]
    return config


def vectors_or_disabled(spark: SparkSession, path: str):
    """The table of embeddings; a clear refusal where there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FeatureDisabled(f"vector search needs a table of embeddings, and there is none at {path}")
    return spark.read.parquet(path)
