"""Fill-in-the-middle: texts cut at two ranks into prefix, middle and suffix, and
written with the middle last.

Ranks count units, a run of ASCII letters or one other code point, while strings
are cut at code points. An indexable skip list leads from one to the other: every
lane's node knows how many units and how many code points lie up to the next node
of its lane, and a descent adds up both until the rank is reached exactly. One node
in four of a lane is in the lane above. Which ones depends on the node's
number alone, so lanes and the ways down are shared by all texts, and only the
widths are of one text.

Null and empty texts have no units and stay plain. So do texts in which a sentinel
occurs, as they could not be told apart again. Repeated rows are cut alike, as the
random numbers depend on the id alone (those of a null id on the empty string). No
rows give no rows. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.text import mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LANE_BITS = 2  # one node in four is in the lane above
_TEXTS_AT_A_TIME = 256
_KEPT_NODES = 1 << 20

_plan: tuple[int, list[np.ndarray], list[np.ndarray]] = (0, [], [])


def _lanes(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes of every lane above the lowest among nodes 0 to n, and the place of each of
    them in the lane below. Node 0, the head, is in all of them."""
    global _plan
    size, nodes, downs = _plan
    if n >= size:
        size = 1 << max(10, int(n).bit_length())
        bits = mix(np.arange(size, dtype=np.uint64) + np.uint64(1))
        nodes, downs, lower, lane = [], [], None, np.arange(size, dtype=np.int32)
        while len(lane) > 4:
            lower, shift = lane, np.uint64(_LANE_BITS * len(nodes))
            up = ((bits[lower] >> shift) & np.uint64((1 << _LANE_BITS) - 1)) == 0
            up[0] = True
            places = np.flatnonzero(up).astype(np.int32)
            lane = lower[places]
            nodes.append(lane)
            downs.append(places)
        if size <= _KEPT_NODES:
            _plan = (size, nodes, downs)
    return nodes, downs


def unit_starts(text: str) -> np.ndarray:
    """The code point at which each unit begins, and after them the text's length."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    begins = np.ones(len(points) + 1, dtype=bool)
    if len(points) > 1:
        begins[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins).astype(np.int32)


class SkipList:
    """Units of one text. Lanes go from the lowest, of all units, to the highest;
    `unit_widths` and `point_widths` of a node reach to the next one of its lane."""

    def __init__(self, starts: np.ndarray):
        self.n = len(starts) - 1
        nodes, downs = _lanes(self.n)
        self.unit_widths = [np.ones(self.n, dtype=np.int32)]
        self.point_widths = [np.diff(starts)]
        self.downs = []
        for lane, down in zip(nodes, downs):
            own = lane[: np.searchsorted(lane, self.n)]
            if len(own) < 2:
                break
            ends = np.append(own, np.int32(self.n))
            self.unit_widths.append(np.diff(ends))
            self.point_widths.append(np.diff(starts[ends]))
            self.downs.append(down[: len(own)])

    def point_of(self, rank: int) -> int:
        """Code points in front of the given number of units."""
        node = units = points = 0
        for lane in range(len(self.unit_widths) - 1, -1, -1):
            widths, reach = self.unit_widths[lane], self.point_widths[lane]
            while node < len(widths) and units + widths[node] <= rank:
                units += int(widths[node])
                points += int(reach[node])
                node += 1
            if lane and node < len(widths):
                node = int(self.downs[lane - 1][node])
            elif lane:  # at the end of the text
                break
        return points


def transformed(docs: DataFrame, rate: int = 90, spm: int = 20, salt: int = 1) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null where plain) and
    output. `rate` of a hundred texts are transformed, and `spm` of a hundred of those
    have the suffix first. Four numbers drawn from salt and id decide on the cuts and
    the form."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    form = F.when(drawn[2] % 100 >= rate, "plain").when(drawn[3] % 100 < spm, "spm").otherwise("psm")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_A_TIME):
                part = batch.slice(at, _TEXTS_AT_A_TIME)
                rows = [_cut(text or "", a, b, kind) for text, a, b, kind in zip(*(part.column(k).to_pylist() for k in range(1, 5)))]
                n, forms, prefixes, middles, outputs = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select("doc_id", "text", drawn[0].alias("a"), drawn[1].alias("b"), form.alias("form")).mapInArrow(cut, schema)


def _cut(text: str, a: int, b: int, form: str) -> tuple[int, str, int | None, int | None, str]:
    starts = unit_starts(text)
    n = len(starts) - 1
    if form == "plain" or not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    units = SkipList(starts)
    first, last = (units.point_of(rank) for rank in sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if form == "psm":
        output = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    else:
        output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, form, first, last - first, output


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (parts.getItem(k) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digest(found: DataFrame) -> DataFrame:
    """The output and the text restored from it as digests."""
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


DIGEST_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  r AS (SELECT *, CAST(len(units) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS x FROM d),
  c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 90 THEN 'plain'
      WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
  s AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM s"""
