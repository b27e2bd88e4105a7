"""Markup residue in texts: found by kind, and turned into clean text.

The text becomes a tree of candidate nodes; gradient-boosted trees over node
features score each, and a hierarchical decoding picks the consistent set.  The
model is trained on the driver from labelled texts that are made by rule
(``SAMPLES`` of them, a bounded sample) and shipped with the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from weftgraph.llm import markup
from weftgraph.llm.gbt import BoostedTrees
from weftgraph.llm.markup_samples import LINE, Maker

#: Labelled texts that the model is trained on.
SAMPLES = 1500
SEED = 20240

_MODEL: BoostedTrees | None = None


def labelled(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the nodes of ``count`` made texts."""
    maker = Maker(seed)
    rows: list[list[float]] = []
    labels: list[int] = []
    for _ in range(count):
        text, spans = maker.text()
        nodes = markup.tree(text)
        # a line that begins with the end of a tag says nothing of quotes: the tag decides
        ends = {n.end for n in nodes if n.kind == markup.TAG}
        clear = [n.kind != markup.QUOTE or text.index(">", n.start) + 1 not in ends for n in nodes]
        rows += [x for x, ok in zip(markup.features(text, nodes), clear) if ok]
        for n in [n for n, ok in zip(nodes, clear) if ok]:
            own = any(_is(n, a, b, f, text) for a, b, f in spans)
            labels.append(int(own))
    return np.array(rows, np.float64), np.array(labels, np.float64)


def _is(n: markup.Node, a: int, b: int, family: int, text: str) -> bool:
    """Whether a made span vouches for a node."""
    if not (a <= n.start and n.end <= b) or family % LINE != markup.FAMILY[n.kind]:
        return False
    if family >= LINE:
        return n.kind in markup.LINES
    # inside code and link targets all is content
    return n.start == a or not (family == markup.MD and text[a] in "`~[")


def model() -> BoostedTrees:
    """The trained model, made once per process."""
    global _MODEL
    if _MODEL is None:
        _MODEL = BoostedTrees().fit(*labelled(SAMPLES, SEED))
    return _MODEL


def analyse(texts: list[str], trees: BoostedTrees) -> list[list[markup.Node]]:
    """The decoded nodes of each text; all nodes are scored in one go."""
    parsed = [markup.tree(t) for t in texts]
    rows: list[list[float]] = []
    for t, nodes in zip(texts, parsed):
        rows += markup.features(t, nodes)
    scores = trees.decision(np.array(rows, np.float64)).tolist() if rows else []
    at = 0
    for nodes in parsed:
        markup.decode(nodes, scores[at : at + len(nodes)])
        at += len(nodes)
    return parsed


_FRONT = re.compile(r"\A---[ \t]*\n.*?^---[ \t]*(?:\n|\Z)", re.S | re.M)


def without_front_matter(raw: str) -> str:
    return _FRONT.sub("", raw, count=1)


def _mask(nodes: list[markup.Node]) -> str:
    return ",".join(markup.FAMILIES[k] for k in sorted(markup.kinds(nodes)))


def describe(df: DataFrame, keep: list[str], texts: list[str], front: list[str], clean: bool = False) -> DataFrame:
    """``keep`` and, per text column, the kinds of its markup (comma-joined).

    ``front`` names columns whose front matter block does not count; with
    ``clean`` the kinds are replaced by the clean text.  A null text gives null,
    an empty one an empty string.  Texts are read whole; a column that ends in
    another one's text (raw and body) is analysed once.
    """
    trees = model()
    rows = df.select(*keep, *texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                cols = [part.column(len(keep) + k).to_pylist() for k in range(len(texts))]
                for k, name in enumerate(texts):
                    if name in front:
                        cols[k] = [None if t is None else without_front_matter(t) for t in cols[k]]
                distinct = list(dict.fromkeys(t for c in cols for t in c if t))
                said = {t: (markup.render(t, nodes) if clean else _mask(nodes)) for t, nodes in zip(distinct, analyse(distinct, trees))}
                out = [pa.array([None if t is None else said[t] if t else "" for t in c], pa.string()) for c in cols]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *out], names=[*keep, *texts])

    schema = StructType([*[rows.schema[c] for c in keep], *[StructField(t, StringType()) for t in texts]])
    return rows.mapInArrow(run, schema)
