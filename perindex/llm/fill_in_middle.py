"""Fill-in-the-middle examples: a text is cut into prefix, middle and suffix, and put in another order.

Cuts are made where lines (or code points) end, but texts are bytes here and never decoded. A
sparse index holds the exceptions alone: the places of characters of more than one byte, and the
bytes that they have in excess. A binary search among them turns a byte cut into a code point cut
and back; between two exceptions the two differ by a constant, so plain ASCII costs a subtraction.
All texts of a batch lie in one buffer and share one index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perindex.llm.text_batches import whole_text

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text that are indexed at once; a longer text is indexed alone.
BATCH_BYTES = 1 << 20
FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ExceptionIndex:
    """Places and excess bytes of the characters of a UTF-8 buffer that have more than one byte."""

    def __init__(self, data: np.ndarray) -> None:
        self.bytes_at = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes_at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        #: Excess bytes of all exceptions before each one, and of all.
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.points_at = self.bytes_at - self.before[:-1]

    def to_points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte cut, which lies between two characters."""
        return cuts - self.before[np.searchsorted(self.bytes_at, cuts)]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Bytes before each cut that is given in code points."""
        return points + self.before[np.searchsorted(self.points_at, points)]


def line_cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Number of lines of each text, and a function from a number of lines to the byte cut after them."""
    breaks = np.flatnonzero(data == 10)
    first, behind = np.searchsorted(breaks, starts), np.searchsorted(breaks, ends)
    open_end = ends > starts
    open_end[open_end] = data[ends[open_end] - 1] != 10
    n = behind - first + open_end

    def cut(units: np.ndarray) -> np.ndarray:
        out = np.where(units == 0, starts, ends)
        inner = (units > 0) & (units < n)
        out[inner] = breaks[first[inner] + units[inner] - 1] + 1
        return out

    return n, cut


def draws(seed: int, key: int | None) -> tuple[int, ...]:
    """Four numbers of 32 bits that depend on the seed and the document alone."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12))


def form_batch(
    keys: list[int | None], data: np.ndarray, offsets: np.ndarray, unit: str, seed: int, fim: int, spm: int
) -> dict[str, list]:
    """The examples of the texts that lie in ``data`` between neighbouring ``offsets``."""
    starts, ends = offsets[:-1], offsets[1:]
    index = ExceptionIndex(data)
    if unit == "lines":
        n, cut = line_cuts(data, starts, ends)
    else:
        from_points = index.to_points(starts)
        n = index.to_points(ends) - from_points

        def cut(units: np.ndarray) -> np.ndarray:
            return index.to_bytes(from_points + units)

    h1, h2, h3, h4 = np.array([draws(seed, key) for key in keys], np.int64).reshape(-1, 4).T
    a, b = h1 % (n + 1), h2 % (n + 1)
    left, right = cut(np.minimum(a, b)), cut(np.maximum(a, b))
    prefix, middle = index.to_points(left) - index.to_points(starts), index.to_points(right) - index.to_points(left)
    plain, suffix_first = h3 % 100 >= fim, h4 % 100 < spm
    whole = data.tobytes()
    forms, outputs, n_prefix, n_middle = [], [], [], []
    for i in range(len(keys)):
        text = whole[starts[i] : ends[i]]
        if plain[i] or not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
            form, parts = "plain", (text,)
        else:
            x, y = left[i] - starts[i], right[i] - starts[i]
            if suffix_first[i]:
                form, parts = "spm", (SUFFIX, text[y:], PREFIX, text[:x], MIDDLE, text[x:y])
            else:
                form, parts = "psm", (PREFIX, text[:x], SUFFIX, text[y:], MIDDLE, text[x:y])
        forms.append(form)
        outputs.append(b"".join(parts))
        n_prefix.append(None if form == "plain" else int(prefix[i]))
        n_middle.append(None if form == "plain" else int(middle[i]))
    return {"n": n, "form": forms, "prefix_chars": n_prefix, "middle_chars": n_middle, "output": outputs}


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``BATCH_BYTES`` in all; one text at least."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
        yield at, min(to, rows)
        at = to


def transform(
    docs: DataFrame,
    seed: int = 7,
    unit: str = "lines",
    fim_percent: int = 100,
    spm_percent: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every document.

    ``n`` counts the units of the text, ``lines`` with their ends or ``chars`` (code points). Two draws
    from the id choose the cuts, a third whether the text is changed at all (``fim_percent``), a fourth
    whether the suffix goes first (``spm_percent``). A text that is null (it counts as empty), empty or
    holds one of the three marks stays ``plain``: its counts of characters are null. Every row counts,
    repeated rows give repeated examples; a null id draws as an empty one. Other columns are not
    carried, an empty table gives an empty one. Texts are cut whole, whatever their length.
    """
    if unit not in ("lines", "chars"):
        raise ValueError(f"no unit {unit!r}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            _, places, values = texts.buffers()
            offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
            for at, to in slices(offsets):
                part = offsets[at : to + 1]
                made = form_batch(
                    keys.slice(at, to - at).to_pylist(), data[part[0] : part[-1]], part - part[0],
                    unit, seed, fim_percent, spm_percent,
                )
                columns = [keys.slice(at, to - at), pa.array(made["n"], pa.int64()), pa.array(made["form"], pa.string())]
                columns += [pa.array(made[name], pa.int64()) for name in ("prefix_chars", "middle_chars")]
                # The bytes are UTF-8 as they came: parts of a text, cut between characters.
                columns.append(pa.array(made["output"], pa.binary()).view(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FORMED.split(", ")])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(task, FORMED)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an example was made from, by its marks alone."""
    def part(text: Column, mark: bytes, number: int) -> Column:
        return F.split_part(text, F.lit(mark.decode()), F.lit(number))

    body = F.expr(f"substring(`{output}`, 4)")
    rest = {"psm": part(body, SUFFIX, 2), "spm": part(body, PREFIX, 2)}
    psm = F.concat(part(body, SUFFIX, 1), part(rest["psm"], MIDDLE, 2), part(rest["psm"], MIDDLE, 1))
    spm = F.concat(part(rest["spm"], MIDDLE, 1), part(rest["spm"], MIDDLE, 2), part(body, PREFIX, 1))
    kind = F.col(f"`{form}`")
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(F.col(f"`{output}`"))


def digests(docs: DataFrame) -> DataFrame:
    """The examples with SHA-256 digests in place of the texts, and of the texts restored from them."""
    formed = transform(docs, seed=7, unit="lines", fim_percent=100, spm_percent=50)
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


#: The same examples as plain SQL.
ORACLE = r"""
with lines as (
  select doc_id, coalesce("text", '') as body,
         case when coalesce("text", '') = '' then []::varchar[] else regexp_extract_all("text", '[^\n]*\n|[^\n]+') end as parts,
         sha256('7:' || doc_id) as digest
  from documents
), drawn as (
  select *, len(parts)::bigint as n, ('0x' || digest[1:8])::ubigint % (len(parts) + 1) as a, ('0x' || digest[9:16])::ubigint % (len(parts) + 1) as b,
         case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') then 'plain'
              when ('0x' || digest[25:32])::ubigint % 100 < 50 then 'spm' else 'psm' end as form
  from lines
), cut as (
  select *, array_to_string(parts[1:least(a, b)::bigint], '') as p, array_to_string(parts[least(a, b)::bigint + 1:greatest(a, b)::bigint], '') as m,
         array_to_string(parts[greatest(a, b)::bigint + 1:], '') as s
  from drawn
)
select doc_id, n, form,
       case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then body when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(p || m || s) as restored_sha256
from cut
"""
