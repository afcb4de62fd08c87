"""Packing into optimal length buckets.

Texts are read once, for their lengths. The histogram of all lengths goes to the driver, length by length: texts
of T words in all have at most sqrt(2 T) different lengths. Dynamic programming over it chooses the bucket boundaries
with the least padding in all. Inside a bucket every text takes the boundary's length, so a batch holds as many
texts as the token budget allows; texts are numbered through a bucket in slices, without a sort of the whole
bucket in one task. Rows of one id and length are counted before they are moved and numbered together.
"""

from __future__ import annotations

import math
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Rows of one id and length that are laid out in one step.
STEP = 4096
#: Where a caller limits the number of bins, lengths below EXACT are bins of their own; longer ones share a bin within 1 part in EXACT / 2.
EXACT = 4096


def token_count(text_col: str) -> Column:
    """Words between white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def length_bin(n: Column) -> Column:
    """Lengths of one bin are those with equal leading bits: at most EXACT / 2 bins for each doubling."""
    n = n.cast("long")
    bits = F.length(F.conv(n.cast("string"), 10, 2))
    down = F.greatest(bits - F.lit(EXACT.bit_length() - 1), F.lit(0))
    unit = F.pow(F.lit(2.0), down).cast("long")
    return (F.floor(n / unit) * unit).cast("long")


def _held(costs: list[int]) -> array | list[int]:
    """Costs in eight bytes each, unless one is larger."""
    return array("q", costs) if max(costs) < 2**63 else costs


def boundaries(histogram: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """The upper ends of at most `buckets` buckets with the least padding.

    histogram: (longest length, texts, sum of lengths) of each bin, in order of length. The cost of a bucket
    from bin i + 1 to j is longest_j * (texts) - (lengths), so each layer is a lower hull of lines. Of equally
    good choices each bucket, from the last on, takes the most bins.
    """
    ends = [h[0] for h in histogram]
    n = len(ends)
    count, total = [0] * (n + 1), [0] * (n + 1)
    for i, (_, c, s) in enumerate(histogram):
        count[i + 1], total[i + 1] = count[i] + c, total[i] + s
    layers = [[0] + [ends[j] * count[j + 1] - total[j + 1] for j in range(n)]]
    for _ in range(1, min(buckets, n)):
        best, new, hull, k = layers[-1], [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1  # a bucket may begin after i bins: value best[i] + total[i] - ends[j - 1] * count[i]
            a, b = -count[i], best[i] + total[i]
            while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (a - hull[-1][0]) <= (b - hull[-1][1]) * (hull[-1][0] - hull[-2][0]):
                hull.pop()
            hull.append((a, b))  # slopes fall, so of two lines that meet the later one is lower beyond
            k = min(k, len(hull) - 1)
            x = ends[j - 1]
            while k + 1 < len(hull) and hull[k + 1][0] * x + hull[k + 1][1] < hull[k][0] * x + hull[k][1]:
                k += 1
            new[j] = hull[k][0] * x + hull[k][1] + x * count[j] - total[j]
        layers[-1] = _held(best)
        layers.append(new)
    out, j = [], n
    for k in range(len(layers) - 1, -1, -1):
        if not j:
            break
        x = ends[j - 1]
        out.append(x)
        if k:
            before = layers[k - 1]
            j = next(i for i in range(j) if before[i] + x * (count[j] - count[i]) - (total[j] - total[i]) == layers[k][j])
    return out[::-1]


def histogram(lengths: DataFrame, col: str, rows: str | None = None, most: int | None = None) -> list[tuple[int, int, int]]:
    """(longest, texts, sum) of each bin of `col`, from all rows (`rows`: how often each counts).

    A bin is one length, whatever the input's size. Only a caller who gives `most` gets EXACT + EXACT / 2 * log2(longest)
    bins at most where there are more lengths.
    """
    n = F.greatest(F.col(col), F.lit(1)).cast("long")
    each = cut(lengths.groupBy(n.alias("_n")).agg((F.sum(rows) if rows else F.count("*")).alias("_c")))
    bins = each.groupBy((length_bin(F.col("_n")) if most is not None and each.count() > most else F.col("_n")).alias("_bin"))
    bins = bins.agg(F.max("_n"), F.sum("_c"), F.sum(F.col("_n") * F.col("_c")))
    return [(int(r[1]), int(r[2]), int(r[3])) for r in sorted(bins.collect())]


def _slice(key: Column, slices: int) -> Column:
    """The slice of an id, from a hash that other engines have as well; slice 0 for a null id."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % slices, F.lit(0)).cast("int")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 32768, tokens: Column | None = None, slice_rows: int = 50_000, most: int | None = None) -> DataFrame:
    """(id, n_tokens, bucket, padded_tokens, batch) for every row.

    bucket counts from 0 by length; padded_tokens is its boundary; batch counts from 0 inside a bucket and
    holds budget // boundary texts, or one if a text alone is longer than the budget. Null and empty texts
    have 0 tokens and take part with length 1. All batches of a bucket but its last are full. Rows of one id
    follow each other, also those without an id; an empty table gives an empty result. Other columns are not read.
    """
    n = (tokens if tokens is not None else token_count(text_col)).cast("long")
    read = cut(docs.select(F.col(id_col).alias("_id"), F.coalesce(n, F.lit(0)).cast("long").alias("n_tokens")))
    rows = read.groupBy("_id", "n_tokens").agg(F.count("*").alias("_rows"))
    counts = histogram(read, "n_tokens", most=most)
    ends = boundaries(counts, buckets)
    total = sum(c for _, c, _ in counts)
    slices = max(32, math.ceil(total / slice_rows))
    bucket, padded = F.lit(max(0, len(ends) - 1)), F.lit(ends[-1] if ends else 1)
    for k in range(len(ends) - 2, -1, -1):
        inside = F.col("n_tokens") <= ends[k]
        bucket, padded = F.when(inside, k).otherwise(bucket), F.when(inside, ends[k]).otherwise(padded)
    dealt = rows.select("_id", "n_tokens", "_rows", bucket.cast("int").alias("bucket"), padded.cast("long").alias("padded_tokens"), _slice(F.col("_id"), slices).alias("_slice"))
    # the slices of a bucket follow each other: a row's number is what the slices before it hold, and its place in its own
    sizes = dealt.groupBy("bucket", "_slice").agg(F.sum("_rows").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy("bucket").orderBy("_slice")) - F.col("_held")
    offsets = sizes.select(F.col("bucket").alias("_b"), F.col("_slice").alias("_s"), before.alias("_before"))
    own = Window.partitionBy("bucket", "_slice").orderBy("_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.withColumn("_first", F.sum("_rows").over(own) - F.col("_rows")).join(offsets, (F.col("bucket") == F.col("_b")) & (F.col("_slice") == F.col("_s")))
    fit = F.greatest(F.floor(F.lit(budget) / F.col("padded_tokens")), F.lit(1))
    met = met.select("_id", "n_tokens", "bucket", "padded_tokens", (F.col("_before") + F.col("_first")).alias("_at"), "_rows")
    # rows of one id and length, however many, in two steps: no array is longer than STEP, or than a STEP-th of them
    far = F.greatest(F.lit(STEP), F.ceil(F.sqrt("_rows"))).cast("long")
    met = met.withColumn("_far", far).withColumn("_begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1, F.col("_far"))))
    met = met.withColumn("_place", F.explode(F.sequence(F.col("_begin"), F.least(F.col("_begin") + F.col("_far"), F.col("_rows")) - 1)))
    return met.select(F.col("_id").alias(id_col), "n_tokens", "bucket", "padded_tokens", F.floor((F.col("_at") + F.col("_place")) / fit).cast("long").alias("batch"))


def oracle(buckets: int = 16, budget: int = 32768, slice_rows: int = 50_000) -> str:
    """The same by DuckDB over documents: one layer of the dynamic program after another, over all pairs of lengths."""
    n = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    first = f"""WITH RECURSIVE d AS (SELECT doc_id, CAST({n} AS BIGINT) AS n_tokens FROM documents),
l AS (SELECT greatest(n_tokens, 1) AS n FROM d), h AS (SELECT n AS b, n AS x, count(*) AS c, sum(n) AS s FROM l GROUP BY n),
p AS (SELECT row_number() OVER (ORDER BY b) AS j, x, sum(c) OVER (ORDER BY b) AS c, sum(s) OVER (ORDER BY b) AS s FROM h),
z AS (SELECT 0 AS j, 0 AS x, 0 AS c, 0 AS s UNION ALL SELECT j, x, c, s FROM p),
l1 AS (SELECT j, x * c - s AS cost, 0 AS i FROM z)"""
    layers = [
        f"l{k} AS (SELECT j, CASE WHEN j = 0 THEN 0 ELSE m.cost END AS cost, m.i AS i FROM (SELECT z.j, min({{'cost': q.cost + z.x * (z.c - y.c) - (z.s - y.s), 'i': y.j}}) AS m "
        f"FROM z JOIN z y ON y.j < z.j OR z.j = 0 AND y.j = 0 JOIN l{k - 1} q ON q.j = y.j GROUP BY z.j))"
        for k in range(2, buckets + 1)
    ]
    # of equally good beginnings the first bin counts, as in boundaries(); fewer bins than buckets need fewer layers
    back = [f"e{buckets} AS (SELECT max(j) AS j FROM z)"]
    for k in range(buckets, 1, -1):
        back.append(f"e{k - 1} AS (SELECT CASE WHEN {k} > (SELECT max(j) FROM z) THEN e{k}.j ELSE l{k}.i END AS j FROM e{k} JOIN l{k} ON l{k}.j = e{k}.j)")
    ends = " UNION ".join(f"SELECT j FROM e{k}" for k in range(1, buckets + 1))
    rest = f"""t AS (SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS bucket, CAST(x AS BIGINT) AS padded FROM z WHERE j > 0 AND j IN ({ends})),
m AS (SELECT d.*, (SELECT min(bucket) FROM t WHERE padded >= d.n_tokens) AS bucket FROM d),
w AS (SELECT doc_id, n_tokens, m.bucket, padded, coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % greatest(32, CAST(ceil((SELECT count(*) FROM d) / {slice_rows}::DOUBLE) AS BIGINT)), 0) AS slice FROM m JOIN t ON t.bucket = m.bucket)
SELECT doc_id, n_tokens, bucket, padded AS padded_tokens,
 CAST((row_number() OVER (PARTITION BY bucket ORDER BY slice, doc_id, n_tokens) - 1) // greatest({budget} // padded, 1) AS BIGINT) AS batch FROM w"""
    return ",\n".join([first, *layers, *back, rest])
