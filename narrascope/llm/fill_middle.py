"""Fill-in-the-middle training texts by displacement scatter (the format is that of Bavarian et al. 2022).

A text is cut twice at token bounds into prefix, middle and suffix, and written with the middle last. All texts of a
batch are one byte array. The cuts are found by one scan of it; a difference array holds how far the output place of a
byte lies from its input place, changing only at cuts; its running sum gives every byte its place, and one scatter writes
all outputs. `restore_text` finds the marks in an output, builds the inverse shifts and gathers the text back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.spark import small_batches

#: Letters of the marks `<P>`, `<S>`, `<M>` before prefix, suffix and middle.
_LETTERS = np.frombuffer(b"PSM", dtype=np.uint8)
MARK = 3
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
#: Bytes of text that are moved at once. A longer text is moved by itself.
SLICE_BYTES = 4 << 20

_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string array and the n + 1 bounds of its texts. A null is an empty text."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def byte_texts(raw: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The inverse of `text_bytes`."""
    places = bounds.astype(np.int64 if pa.types.is_large_string(kind) else np.int32)
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(raw))])


def slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES each."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, "right")) - 1)
        yield first, last
        first = last


def draws(keys: list, salt: str) -> np.ndarray:
    """The first four 8-digit groups of the SHA-256 of salt and key, as integers. A null key is drawn as the empty text."""
    digests = b"".join(hashlib.sha256(f"{salt}{'' if k is None else k}".encode()).digest()[:16] for k in keys)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def mark_places(raw: np.ndarray, bounds: np.ndarray, letters: np.ndarray = _LETTERS) -> np.ndarray:
    """Places of the marks that lie within one text each."""
    at = np.flatnonzero((raw[:-2] == ord("<")) & (raw[2:] == ord(">")) & np.isin(raw[1:-1], letters)) if len(raw) > 2 else np.empty(0, np.int64)
    return at[at + MARK <= bounds[np.searchsorted(bounds, at, "right")]]


def _shifts(size: int, starts: list[np.ndarray], shifts: list[np.ndarray]) -> np.ndarray:
    """Shift of each byte, from the starts of all pieces in their order along the bytes and the shift of each piece.

    The pieces of a text follow each other, as do the texts, so a piece ends where the next one starts.
    """
    start, shift = np.stack(starts, 1).ravel(), np.stack(shifts, 1).ravel()
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, start, np.diff(shift, prepend=0))
    return np.cumsum(steps[:size])


def rearrange(raw: np.ndarray, bounds: np.ndarray, h: np.ndarray, plain_from: int, spm_below: int) -> dict[str, np.ndarray]:
    """Cut and move the texts of a slice; see `fill_in_middle`. `bytes` and `bounds` hold the outputs."""
    start, end, count = bounds[:-1], bounds[1:], len(bounds) - 1
    chars = (raw & 0xC0) != 0x80
    begins, letter = chars.copy(), _ASCII_LETTER[raw]
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[start[start < end]] = True
    tokens = np.append(np.flatnonzero(begins), len(raw))
    first = np.searchsorted(tokens[:-1], bounds)
    n = np.diff(first)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cut = [np.where(cuts[:, i] < n, tokens[np.minimum(first[:-1] + cuts[:, i], len(tokens) - 1)], end) for i in (0, 1)]

    form = np.where(h[:, 3] % 100 < spm_below, SPM, PSM)
    marked = np.searchsorted(bounds, mark_places(raw, bounds), "right") - 1
    form[(n == 0) | (h[:, 2] % 100 >= plain_from)] = PLAIN
    form[marked] = PLAIN

    moved = form != PLAIN
    out_bounds = np.concatenate(([0], np.cumsum(end - start + 3 * MARK * moved)))
    base, prefix, suffix = out_bounds[:-1], cut[0] - start, end - cut[1]
    # Places of the three pieces; the middle always comes last.
    to_prefix = np.where(form == SPM, base + 2 * MARK + suffix, base + MARK)
    to_suffix = np.where(form == SPM, base + MARK, base + 2 * MARK + prefix)
    to_middle = base + 3 * MARK + prefix + suffix
    shift = _shifts(len(raw), [start, cut[0], cut[1]],
                    [np.where(moved, to - at, base - start) for to, at in ((to_prefix, start), (to_middle, cut[0]), (to_suffix, cut[1]))])
    out = np.empty(out_bounds[-1], np.uint8)
    out[np.arange(len(raw)) + shift] = raw
    for to, letter_ in zip((to_prefix, to_suffix, to_middle), _LETTERS):
        at = to[moved] - MARK
        out[at], out[at + 1], out[at + 2] = ord("<"), letter_, ord(">")

    upto = np.concatenate(([0], np.cumsum(chars)))
    return {"bytes": out, "bounds": out_bounds, "form": form, "n": n, "prefix_chars": upto[cut[0]] - upto[start],
            "middle_chars": upto[cut[1]] - upto[cut[0]], "count": np.array(count)}


def gather_back(raw: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, bounds and validity of the texts that were rearranged into these outputs.

    An output that is not plain must hold each of the three marks once, in the order of its form; others are invalid.
    """
    start, end = bounds[:-1], bounds[1:]
    places = mark_places(raw, bounds)
    owner = np.searchsorted(bounds, places, "right") - 1
    at = np.full((3, len(start)), -1, np.int64)
    for i, letter in enumerate(_LETTERS):
        own = raw[places + 1] == letter
        at[i, owner[own]] = places[own]
    marks = np.bincount(owner, minlength=len(start))
    front, back = np.where(form == SPM, at[1], at[0]), np.where(form == SPM, at[0], at[1])
    moved = (form != PLAIN) & (marks == 3) & (front == start) & (front < back) & (back < at[2])
    valid = moved | (form == PLAIN)

    size = np.where(moved, end - start - 3 * MARK, np.where(valid, end - start, 0))
    own_bounds = np.concatenate(([0], np.cumsum(size)))
    base = own_bounds[:-1]
    prefix = np.where(moved, np.where(form == SPM, at[2], at[1]) - at[0] - MARK, 0)
    suffix = np.where(moved, np.where(form == SPM, at[0], at[2]) - at[1] - MARK, 0)
    middle = size - prefix - suffix
    pieces = [base, base + prefix, base + prefix + middle]
    source = [at[0] + MARK, np.where(moved, at[2] + MARK, start), at[1] + MARK]
    shift = _shifts(int(own_bounds[-1]), pieces, [np.where(moved, frm - to, start - base) for frm, to in zip(source, pieces)])
    return raw[np.arange(own_bounds[-1]) + shift], own_bounds, valid


_SCHEMA = "output string, form string, n long, prefix_chars long, middle_chars long"


def fill_in_middle(df: DataFrame, text: str = "text", key: str = "doc_id", out: str = "fim", salt: str = "1:",
                   plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Add the struct (output, form, n, prefix_chars, middle_chars), in place of a column of that name.

    The text is n tokens `[A-Za-z]+|[^A-Za-z]` long. h1 to h4 are read from the SHA-256 of salt and key: the cuts lie
    after h1 % (n + 1) and h2 % (n + 1) tokens; a text that is empty, holds one of the marks, or has h3 % 100 of
    `plain_from` or more stays plain; the suffix leads (spm) if h4 % 100 is below `spm_below`, else the prefix (psm).
    A null text counts as empty, a null key as the empty text. Rows of equal key are cut by equal draws. Other columns
    come through unchanged, and nothing is shuffled.
    """
    small_batches(df.sparkSession)

    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        raw, bounds = text_bytes(texts)
        h, found = draws(keys.to_pylist(), salt), []
        for i, j in slices(bounds):
            part = rearrange(raw[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], h[i:j], plain_from, spm_below)
            plain = part["form"] == PLAIN
            found.append(pa.StructArray.from_arrays(
                [byte_texts(part["bytes"], part["bounds"], pa.string()),
                 pa.array(np.array(FORMS, dtype=object)[part["form"]], pa.string()), pa.array(part["n"]),
                 pa.array(part["prefix_chars"], mask=plain), pa.array(part["middle_chars"], mask=plain)],
                ["output", "form", "n", "prefix_chars", "middle_chars"]))
        return pa.concat_arrays(found)

    run.__annotations__ = {"texts": pa.Array, "keys": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(run, _SCHEMA).asNondeterministic()(df[text].cast("string"), df[key].cast("string")))


def restore_text(df: DataFrame, output: str = "fim.output", form: str = "fim.form", out: str = "restored") -> DataFrame:
    """Add the text that was rearranged into an output of a form, in place of a column of that name.

    Null where the output lacks the marks of its form or the form is unknown or null. A null output is an empty one.
    """
    small_batches(df.sparkSession)

    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        raw, bounds = text_bytes(outputs)
        codes = {name: i for i, name in enumerate(FORMS)}
        own, found = np.array([codes.get(f, -1) for f in forms.to_pylist()], np.int64), []
        for i, j in slices(bounds):
            data, places, valid = gather_back(raw[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], own[i:j])
            texts = byte_texts(data, places, pa.string())
            found.append(texts if valid.all() else pc.if_else(pa.array(valid), texts, pa.scalar(None, pa.string())))
        return pa.concat_arrays(found)

    run.__annotations__ = {"outputs": pa.Array, "forms": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(run, "string").asNondeterministic()(F.col(output), F.col(form)))


def fill_middle_query(docs: DataFrame) -> DataFrame:
    """The contract of op11: digests of each output and of the text restored from it."""
    done = restore_text(fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "fim"))
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
                       F.sha2("fim.output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


FILL_SQL = """
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM parts),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM pieces
"""
