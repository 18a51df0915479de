"""Many labels looked for in texts at once, by Aho-Corasick automata."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.arrow import filesystem, slices
from cairn.session import materialise, scratch

#: Characters of labels in an automaton (some 40 bytes each in a task), and bytes of texts that meet all automata at once.
BLOCK_CHARS, SLAB_BYTES = 1 << 20, 32 << 20


@lru_cache(maxsize=2)
def _automaton(uri: str) -> ahocorasick.Automaton:
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        return pickle.loads(f.read())


def automata(labels: DataFrame) -> list[str]:
    """The URIs of automata over distinct `labels` (n, label), of bounded size each; a match gives n.

    Each is built once, in a task, and written to the shared folder.
    """
    total = labels.agg(F.sum(F.length("label"))).first()[0] or 0
    folder = scratch(labels.sparkSession, "automata")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for batch in batches:
            for n, label in zip(batch.column("n").to_pylist(), batch.column("label").to_pylist()):
                found.add_word(label, n)
        if len(found):
            found.make_automaton()
            uri = f"{folder}/{uuid.uuid4().hex}"
            system, path = filesystem(uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(pickle.dumps(found))
            yield pa.RecordBatch.from_pydict({"uri": [uri]})

    blocks = labels.select("n", "label").repartition(-(-total // BLOCK_CHARS) or 1, "label")
    # only files that a finished task names count
    names = materialise(blocks.mapInArrow(build, "uri string"), "automata-names")
    return sorted(r.uri for r in names.collect())  # bounded: one for BLOCK_CHARS of labels


def containing(texts: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, id): the labels (id, label) that stand anywhere in a text (doc_id, text), each once.

    Distinct labels go into automata; a task reads its texts once for each automaton, whatever the number and the length of labels in it.
    Empty and null labels, and null texts, match nothing; ids that share a label are all found.
    """
    named = labels.where("label <> ''").select("id", "label")
    distinct = materialise(named.select("label").distinct().withColumn("n", F.monotonically_increasing_id()), "labels")
    uris = automata(distinct)
    ids = materialise(named.join(distinct, "label").select("n", "id"), "label-ids")

    def slab(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for uri in uris:
            automaton = _automaton(uri)
            at, found = [], []
            for row, text in enumerate(table.column("text").to_pylist()):
                own = {n for _, n in automaton.iter(text)}
                at += [row] * len(own)
                found += own
                if len(at) >= 1 << 16:
                    yield _pairs(table, at, found)
                    at, found = [], []
            yield _pairs(table, at, found)

    def _pairs(table: pa.Table, at: list, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([table.column(id_col).take(pa.array(at, pa.int64())).combine_chunks(), pa.array(found, pa.int64())], [id_col, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text"):
            held.append(part)
            size += part.nbytes
            if size >= SLAB_BYTES:
                yield from slab(held)
                held, size = [], 0
        if held:
            yield from slab(held)

    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.where(F.col("text").isNotNull()).select(id_col, "text")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n long").join(ids, "n").select(id_col, "id")
