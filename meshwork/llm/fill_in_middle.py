"""Fill-in-middle: documents rearranged around their middle, over ropes.

A text becomes a rope: a binary tree whose leaves hold short runs of whole units (a word with the white
space before it, or white space at the end) and cache how many units and code points they have; inner nodes
cache the sums. Two splits at unit ranks give prefix, middle and suffix as trees that share their leaves with
the text's; concatenation with sentinels rearranges them without copying text. The inverse splits the
output's rope at the code points where its sentinels start and end, and joins the parts in their old order.

Where the cuts lie and which form a document takes comes from a hash of its doc_id, so reruns agree and no
shuffle is needed: each document is worked on where it is read.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, is left as it is (form
plain); a null doc_id hashes as an empty string; repeated rows are rearranged alike; a text of any length is
one rope (a single unit of any length is one leaf); an empty table gives no rows; other columns pass
through under any name, as long as the names asked for in ``columns`` are not among them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meshwork.llm.common import pieces, text_or_empty

#: Units of a leaf, at most.
LEAF = 512
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 42, 50, 80

_ends = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_SPACE = np.array([9, 10, 11, 12, 13, 32], np.uint32)


class Rope:
    """A leaf (text) or the concatenation of two ropes; units and chars are cached. Ropes are never changed."""

    __slots__ = ("text", "left", "right", "units", "chars")

    def __init__(self, text: str | None, left: Rope | None, right: Rope | None, units: int, chars: int):
        self.text, self.left, self.right, self.units, self.chars = text, left, right, units, chars

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            at = todo.pop()
            if at.left is None:
                out.append(at.text)
            else:
                todo += (at.right, at.left)
        return "".join(out)


EMPTY = Rope("", None, None, 0, 0)


def leaf(text: str, units: int | None = None) -> Rope:
    return Rope(text, None, None, len(_ends.findall(text)) if units is None else units, len(text))


def joined(*ropes: Rope) -> Rope:
    out = EMPTY
    for x in ropes:
        if not out.chars:
            out = x
        elif x.chars:
            out = Rope(None, out, x, out.units + x.units, out.chars + x.chars)
    return out


def unit_ends(text: str) -> np.ndarray:
    """Code points up to the end of each unit."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    word = ~np.isin(points, _SPACE)
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    return ends if not len(points) or word[-1] else np.append(ends, len(points))


def rope(text: str, size: int = LEAF) -> Rope:
    """A balanced rope of text."""
    ends = unit_ends(text)
    last = np.append(np.arange(size, len(ends), size), len(ends))  # units up to the end of each leaf
    level, start, before = [], 0, 0
    for units in last.tolist():
        if units > before:
            stop = int(ends[units - 1])
            level.append(Rope(text[start:stop], None, None, units - before, stop - start))
            start, before = stop, units
    while len(level) > 1:
        level = [joined(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def split_units(tree: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the others."""
    if rank <= 0:
        return EMPTY, tree
    if rank >= tree.units:
        return tree, EMPTY
    if tree.left is None:
        at = int(unit_ends(tree.text)[rank - 1])
        return Rope(tree.text[:at], None, None, rank, at), Rope(tree.text[at:], None, None, tree.units - rank, tree.chars - at)
    if rank <= tree.left.units:
        a, b = split_units(tree.left, rank)
        return a, joined(b, tree.right)
    a, b = split_units(tree.right, rank - tree.left.units)
    return joined(tree.left, a), b


def split_chars(tree: Rope, at: int) -> tuple[Rope, Rope]:
    """The first ``at`` code points, and the others."""
    if at <= 0:
        return EMPTY, tree
    if at >= tree.chars:
        return tree, EMPTY
    if tree.left is None:
        return leaf(tree.text[:at]), leaf(tree.text[at:])
    if at <= tree.left.chars:
        a, b = split_chars(tree.left, at)
        return a, joined(b, tree.right)
    a, b = split_chars(tree.right, at - tree.left.chars)
    return joined(tree.left, a), b


def rearranged(text: str, h: tuple[int, int, int, int], sentinels: tuple[str, str, str] = SENTINELS, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the output of a text, by four hashes."""
    whole = rope(text)
    n = whole.units
    if not text or h[2] % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    rest, suffix = split_units(whole, high)
    prefix, middle = split_units(rest, low)
    p, s, m = map(leaf, sentinels)
    spm = h[3] % 100 < spm_rate
    out = joined(s, suffix, p, prefix, m, middle) if spm else joined(p, prefix, s, suffix, m, middle)
    return n, "spm" if spm else "psm", prefix.chars, middle.chars, str(out)


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text, from output and form alone."""
    if form == "plain":
        return output
    first, second, third = (sentinels[i] for i in ((1, 0, 2) if form == "spm" else (0, 1, 2)))
    at = output.index(second, len(first))
    _, tree = split_chars(rope(output), len(first))
    a, tree = split_chars(tree, at - len(first))
    _, tree = split_chars(tree, len(second))
    b, tree = split_chars(tree, output.rindex(third) - at - len(second))
    _, middle = split_chars(tree, len(third))
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return str(joined(prefix, middle, suffix))


def hashes(doc_id: Column, seed: int = SEED) -> Column:
    """Four 32-bit numbers by seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)))


def _mapped(rows: DataFrame, n_in: int, fields: str, text: int, work) -> DataFrame:
    """rows without their first ``n_in`` columns, and with the fields that work makes of these columns' values, row by row; texts in bounded pieces."""
    kept = StructType(rows.schema.fields[n_in:])
    schema = StructType(kept.fields + StructType.fromDDL(fields).fields)
    made = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            values = [work(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(n_in)))]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*values), made)]
            yield pa.RecordBatch.from_arrays(batch.columns[n_in:] + columns, [f.name for f in schema])

    return rows.toDF(*(f"_{i}" for i in range(len(rows.columns)))).mapInArrow(run, schema)  # names with dots can't be asked for


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS, columns: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"), keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns keep of it) with columns: units, form (plain, psm, spm), code points of prefix and middle (null if plain), output.

    rate: rearranged documents of 100; spm_rate: of 100 of these, those whose suffix comes first. No sentinel may overlap with itself or another.
    """
    types = ("bigint", "string", "bigint", "bigint", "string")
    kept = ["*"] if keep is None else [F.col(f"`{c}`") for c in keep]
    rows = docs.select(text_or_empty(F.col(f"`{text}`")).alias("_text"), hashes(F.col(f"`{doc_id}`"), seed).alias("_h"), *kept)
    return _mapped(rows, 2, ", ".join(f"`{c}` {t}" for c, t in zip(columns, types)), 0, lambda x, h: rearranged(x, h, sentinels, rate, spm_rate))


def restore(made: DataFrame, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS, column: str = "restored") -> DataFrame:
    """made (all its columns) with the texts that its outputs were made of."""
    rows = made.select(F.col(f"`{output}`").alias("_output"), F.col(f"`{form}`").alias("_form"), "*")
    return _mapped(rows, 2, f"`{column}` string", 0, lambda x, f: (restored(x, f, sentinels),))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    made = restore(fill_in_middle(docs, keep=["doc_id"]))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
