"""Fill-in-middle examples, cut with succinct rank and select.

A batch of texts is one run of UTF-8 bytes. One bit vector marks the bytes where a token begins, another those where a
code point begins. Both are packed eight bits to a byte beside a directory of the ones before each block, so that the ones before a
place (rank) and the place of a one (select) are a look into the directory and one block. The ones of a text are its number of
tokens, a select for either rank gives the byte where the text is cut, and ranks of code points give the lengths.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: Marks of the three parts, fixed by the format of the examples.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a bit vector under one entry of its directory: 512 bits.
BLOCK = 64
#: Bytes of text that are worked on at once (or one text, if that is longer).
AT_ONCE = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class BitVector:
    """Packed bits with a directory of the ones before each block."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.packed = np.concatenate([packed, np.zeros(-len(packed) % BLOCK + BLOCK, np.uint8)]).reshape(-1, BLOCK)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed).sum(axis=1, dtype=np.int64))])

    def _inside(self, blocks: np.ndarray) -> np.ndarray:
        """The ones up to and with each bit of the blocks."""
        return np.cumsum(np.unpackbits(self.packed[blocks], axis=1, bitorder="little"), axis=1, dtype=np.int16)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        places = np.asarray(places, np.int64)
        out = np.empty(len(places), np.int64)
        for at in range(0, len(places), 4096):
            block, bit = np.divmod(places[at : at + 4096], 8 * BLOCK)
            ones = self._inside(block)
            out[at : at + 4096] = self.before[block] + np.where(bit > 0, ones[np.arange(len(bit)), bit - 1], 0)
        return out

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of the one with each rank, counted from 0; it must exist."""
        ranks = np.asarray(ranks, np.int64)
        out = np.empty(len(ranks), np.int64)
        for at in range(0, len(ranks), 4096):
            own = ranks[at : at + 4096]
            block = np.searchsorted(self.before, own, side="right") - 1
            ones = self._inside(block)
            out[at : at + 4096] = block * 8 * BLOCK + (ones <= (own - self.before[block])[:, None]).sum(axis=1)
        return out


def cuts(data: np.ndarray, bounds: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts data[bounds[i]:bounds[i + 1]]: tokens, the bytes of both cuts, and code points before these.

    A token is a word with the white space before it, or the white space at a text's end. one and two are any whole numbers; taken
    modulo one more than the tokens, the smaller ends the prefix and the larger the middle. Places count from the text's start.
    """
    starts, ends = bounds[:-1], bounds[1:]
    space = _SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    begins[starts[starts < ends]] = True
    tokens, points = BitVector(begins), BitVector((data & 0xC0) != 0x80)
    first, past = tokens.rank(starts), tokens.rank(ends)
    n = past - first
    low, high = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)
    places = []
    for cut in (low, high):
        inside = cut < n
        at = ends.copy()
        at[inside] = tokens.select((first + cut)[inside])
        places.append(at)
    origin = points.rank(starts)
    return n, places[0] - starts, places[1] - starts, points.rank(places[0]) - origin, points.rank(places[1]) - origin


def numbers(doc_id: object, seed: int) -> list[int]:
    """h1 to h4: the first four groups of eight hexadecimal digits of sha256 over `seed:id`."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def _examples(texts: pa.Array, ids: list, seed: int, fim: int, spm: int) -> list[list]:
    """n, form, code points of prefix and middle, and output of each text."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])  # offsets from 0
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    h = np.array([numbers(x, seed) for x in ids], np.int64).reshape(-1, 4)
    n, low, high, low_points, high_points = cuts(data, bounds, h[:, 0], h[:, 1])
    forms, prefix, middle, out = [], [], [], []
    for i in range(len(texts)):
        text = data[bounds[i] : bounds[i + 1]].tobytes()
        if not text or h[i, 2] % 100 >= fim or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
            forms.append("plain")
            out.append(text)
        else:
            a, b, c = text[: low[i]], text[low[i] : high[i]], text[high[i] :]
            forms.append("spm" if h[i, 3] % 100 < spm else "psm")
            p, s = PREFIX.encode() + a, SUFFIX.encode() + c
            out.append((s + p if forms[-1] == "spm" else p + s) + MIDDLE.encode() + b)
        plain = forms[-1] == "plain"
        prefix.append(None if plain else int(low_points[i]))
        middle.append(None if plain else int(high_points[i] - low_points[i]))
    return [n.tolist(), forms, prefix, middle, out]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim: int = 50, spm: int = 80) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; all columns stay, names that clash get underscores in front.

    Of 100 texts about `fim` are cut into prefix, middle and suffix, of 100 of these about `spm` in the order suffix, prefix,
    middle (spm), the others prefix, suffix, middle (psm). Where is decided by sha256 of seed and id alone, so a row gives the same
    example however the table is laid out, and repeated rows give repeated examples. A null id hashes like an empty one. Null
    and empty texts, and texts that hold a mark, stay plain: output is the text (empty for null), prefix_chars and middle_chars are
    null, n still counts tokens. An empty table gives an empty result. Texts are never shortened; a task holds about AT_ONCE
    bytes of them at once, or one text.
    """
    names = []
    for name in ("n", "form", "prefix_chars", "middle_chars", "output"):
        names.append(free_name([*docs.columns, *names], name))
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, k) for x, k in zip(names, kinds, strict=True))])
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                held = size[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(size, held + AT_ONCE, side="right")))
                part = batch.slice(at, upto - at)
                *small, output = _examples(part.column(text_at), part.column(id_at).to_pylist(), seed, fim, spm)
                made = [pa.array(x, k) for x, k in zip(small, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made, pa.array(output, pa.binary()).cast(pa.string())], names=schema.names)
                at = upto

    return docs.mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text of an example, from its form and output alone."""
    parts = F.split(output, "<[PSM]>")
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def oracle() -> str:
    """The digests by DuckDB over documents: tokens by a regular expression, joined again."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
 CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b FROM h),
p AS (SELECT doc_id, text, n, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
