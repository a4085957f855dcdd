"""Crawled pages as main bodies: one pass of Python over the HTML that every page query starts from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.blocks import Block
from auditloom.llm.crf import Chain
from auditloom.llm.main_body import MAX_LABELLED_PAGES, BodyFinder, train
from auditloom.llm.near_duplicates import Sketcher, sketch_columns, words_of
from auditloom.llm.residue_text import block_kind, masked_words
from auditloom.llm.simhash import SimHasher

#: Pages that Python holds at once, whatever the size of Arrow's batches.
_SLICE = 256
#: Words in a sequence of p4, which its statement fixes.
BODY_SHINGLE = 3
#: A block counts in p5 from so many key characters on.
LEAST_KEY_CHARS = 12
_NO_KEY = re.compile(r"[^a-z0-9]+")

BLOCK_TYPE = "array<struct<kind:tinyint,words:int,n:int,m0:bigint,m1:bigint,m2:bigint,m3:bigint,text:string>>"
_BLOCK = [("kind", pa.int8()), ("words", pa.int32()), ("n", pa.int32()), *[(f"m{k}", pa.int64()) for k in range(4)], ("text", pa.string())]

#: adds a column: its name, Spark type and Arrow type, and what makes, once for each task, the function that gives its values
#: for the main blocks of the pages of a slice
Extra = tuple[str, str, pa.DataType, Callable[[], Callable[[list[list[Block]]], list]]]


def with_html(pages: DataFrame) -> DataFrame:
    """page_id, status_code and html of the pages that have any; copies of a row are still in it."""
    return pages.select("page_id", "status_code", "html").where("page_id is not null and html is not null and html != ''")


def fit_model(pages: DataFrame, most: int = MAX_LABELLED_PAGES) -> Chain:
    """Main-body model from at most `most` pages, labelled by rules: those with the least hashes of their ids, wherever they are.

    The hash below which about nine tenths of `most` pages lie is known from their number, so no task sends more than its
    share of the sample to the driver.
    """
    bound = -(2**63) + min(2**64 - 1, int(2**64 * 0.9 * most / max(1, pages.count())))
    place = F.xxhash64("page_id")
    sample = with_html(pages).where(place <= bound).select(place.alias("place"), "html").toPandas().sort_values(["place", "html"])
    return train(list(sample["html"].head(most)))


def page_bodies(pages: DataFrame, model: Chain, extra: Extra | None = None, blocks: bool = True) -> DataFrame:
    """page_id, status_code, blocks (each main block as `residue` needs it) and a column made by `extra`, for pages with html.

    Pages without main body have an empty list. Copies of a row come out as often as they come in.
    """
    ddl = "page_id bigint, status_code int" + (f", blocks {BLOCK_TYPE}" if blocks else "") + (f", {extra[0]} {extra[1]}" if extra else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, hasher = BodyFinder(model), SimHasher()
        values = extra[3]() if extra else None
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                bodies = [finder.main_blocks(html) for html in batch.column(2).to_pylist()]
                columns, names = [batch.column(0), batch.column(1)], ["page_id", "status_code"]
                if blocks:
                    columns.append(_block_column(bodies, hasher))
                    names.append("blocks")
                if extra:
                    columns.append(pa.array(values(bodies), extra[2]))
                    names.append(extra[0])
                yield pa.RecordBatch.from_arrays(columns, names)

    return with_html(pages).mapInArrow(run, ddl)


def _block_column(bodies: list[list[Block]], hasher: SimHasher) -> pa.Array:
    flat = [b for body in bodies for b in body]
    words = [masked_words(b.text) for b in flat]
    distinct = [set(w) for w in words]
    marks = hasher(distinct)
    silent = np.array([b.code or not d - {"0"} for b, d in zip(flat, distinct)], bool)
    offsets = [0]
    for body in bodies:
        offsets.append(offsets[-1] + len(body))
    values = [[block_kind(b) for b in flat], [len(w) for w in words], [len(d) for d in distinct]]
    arrays = [pa.array(v, kind) for v, (_, kind) in zip(values, _BLOCK)]
    arrays += [pa.array(marks[:, k], pa.int64(), mask=silent) for k in range(4)]
    arrays.append(pa.array([" ".join(w) for w in words], pa.string()))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, fields=[pa.field(*f) for f in _BLOCK]))


def block_keys(bodies: list[list[Block]]) -> list[list[bytes]]:
    """MD5 of the letters and digits of each block that is one element and long enough; each once for a page."""
    md5 = hashlib.md5
    found = []
    for body in bodies:
        keys = {}
        for b in body:
            if b.leaf and len(plain := _NO_KEY.sub("", b.text.lower())) >= LEAST_KEY_CHARS:
                keys[md5(plain.encode()).digest()] = None
        found.append(list(keys))
    return found


def _near_values() -> Callable[[list[list[Block]]], list]:
    sketcher = Sketcher(BODY_SHINGLE)
    return lambda bodies: sketch_columns([[w for b in body if b.leaf for w in words_of(b.text)] for body in bodies], sketcher)


KEYS: Extra = ("keys", "array<binary>", pa.list_(pa.binary()), lambda: block_keys)
NEAR: Extra = (
    "near",
    "struct<class:binary,sketch:binary,buckets:array<bigint>,body:string>",
    pa.struct([("class", pa.binary()), ("sketch", pa.binary()), ("buckets", pa.list_(pa.int64())), ("body", pa.string())]),
    _near_values,
)


def main_body_keys(bodies: DataFrame, residue: DataFrame) -> DataFrame:
    """page_id and block_key (hex MD5) of the main blocks, each once, without the pages of `residue`."""
    kept = bodies.select("page_id", "keys").join(residue, "page_id", "left_anti").dropDuplicates(["page_id"])
    return kept.select("page_id", F.explode("keys").alias("key")).select("page_id", F.lower(F.hex("key")).alias("block_key"))
