"""Chunking: a text becomes rows (chunk_index, offset, chunk).

Fixed character windows are a Catalyst expression. The other modes carry state from line to line
or paragraph to paragraph, so one Arrow-batched generator makes a whole document's chunks.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.functions import text as T

TARGET, OVERLAP, LINES, LINE_OVERLAP, LOOK_BACK = 800, 100, 50, 10, 10
MIN_CHUNK, MAX_CHUNK = 128, 65_536
CODE = tuple("bash c cjs cpp cs fish go graphql h hpp java js jsx kt mjs php proto py rb rs scala sh sql swift ts tsx zsh".split())
PROSE = ("md", "rst")
_BLANK = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
SPACE = "\t\n\f\r "  # what \s is in SQL
_ATX, _RULE = re.compile(r"#{1,6}\s"), re.compile(r"[=-]{3,}\s*$")

Chunk = tuple[int, str]


def clamp_size(n: int | None) -> int:
    return TARGET if n is None else max(MIN_CHUNK, min(MAX_CHUNK, int(n)))


def mode_of(path: Column, asked: str = "auto") -> Column:
    """'line' for code, 'section' for Markdown and RST, 'paragraph' for the rest."""
    if asked != "auto":
        return F.lit("paragraph" if asked == "legacy" else asked)
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*CODE), "line").when(ext.isin(*PROSE), "section").otherwise("paragraph")


def char_windows(text: Column, target: int = TARGET, overlap: int = OVERLAP, blank: str = _BLANK) -> Column:
    """array<struct<offset,chunk>> of windows trimmed of `blank`; blank ones are left out, a blank text is one empty window.

    The text is cut into steps once, and a window is a step and the beginning of those after it, so
    that the work is linear in the text.
    """
    step = max(1, target - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - target) / F.lit(step))).cast("int")
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    trimmed = lambda c: F.btrim(c, F.lit(blank))

    def window(s: Column, i: Column) -> Column:
        rest = F.array_join(F.slice(s, i + 2, F.lit(-(-overlap // step))), "") if overlap > step else F.coalesce(F.get(s, i + 1), F.lit(""))
        return F.struct((i * step).alias("offset"), trimmed(F.concat(F.get(s, i), F.substring(rest, 1, overlap))).alias("chunk"))

    windows = T.bind(steps, lambda s: F.transform(F.sequence(F.lit(0), F.least(last, F.size(s) - 1)), lambda i: window(s, i)))
    some = F.filter(F.when(F.length(text) > 0, windows), lambda w: w["chunk"] != "")
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.struct(F.lit(0).alias("offset"), trimmed(text).alias("chunk"))))


def _windows(text: str, target: int, overlap: int, base: int) -> list[Chunk]:
    out, at, step = [], 0, max(1, target - overlap)
    while at < len(text):
        piece = text[at : at + target].strip(_BLANK)
        if piece:
            out.append((base + at, piece))
        if at + target >= len(text):
            break
        at += step
    return out or [(base, text.strip(_BLANK))]


def by_paragraph(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[Chunk]:
    """Paragraphs merged up to the target; a new buffer begins with the head of its own first paragraph."""
    out: list[Chunk] = []
    held, held_at, at = "", 0, 0

    def emit():
        nonlocal held
        body = held.strip(_BLANK)
        if body:
            out.extend(_windows(body, target, overlap, held_at) if len(body) > target else [(held_at, body)])
            held = ""

    for raw in re.split(r"\n{2,}", text):
        p = raw.strip(_BLANK)
        if p and len(p) >= target:
            emit()
            out += _windows(p, target, overlap, at)
            held_at = at + len(p)
        elif p and held and len(held) + 1 + len(p) > target:
            emit()
            head = p[:overlap]
            held, held_at = f"{head}\n{p}", at - len(head)
        elif p:
            held, held_at = (f"{held}\n\n{p}", held_at) if held else (p, at)
        at += len(raw) + 2
    emit()
    return out or [(0, text.strip(_BLANK))]


def by_line(text: str, lines: int = LINES, overlap: int = LINE_OVERLAP) -> list[Chunk]:
    """Windows of lines that rather end after a blank line near their end."""
    rows = text.split("\n")
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r) + 1)
    out: list[Chunk] = []
    i = 0
    while i < len(rows):
        j = min(len(rows), i + lines)
        if j < len(rows):
            blank = (x + 1 for x in range(j - 1, max(j - LOOK_BACK, i + 1) - 1, -1) if not rows[x].strip(_BLANK))
            j = next(blank, j)
        body = "\n".join(rows[i:j]).strip(_BLANK)
        if body:
            out.append((starts[i], body))
        if j >= len(rows):
            break
        i = max(i + 1, j - overlap)
    return out or [(0, text.strip(_BLANK))]


def by_section(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[Chunk]:
    """Sections begin at headings; small neighbours merge, large ones are cut by paragraph."""
    rows = text.split("\n")
    begins = [0]
    for i in range(1, len(rows)):
        above = rows[i - 1]
        if _RULE.match(rows[i]) and above.strip(_BLANK) and not _RULE.match(above) and not _ATX.match(above):
            at = i - 1
        elif _ATX.match(rows[i]):
            at = i
        else:
            continue
        if at > begins[-1]:
            begins.append(at)
    if len(begins) == 1 and not _ATX.match(rows[0]):
        return by_paragraph(text, target, overlap)
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r) + 1)
    out: list[Chunk] = []
    held, held_at = "", 0
    for a, b in zip(begins, [*begins[1:], len(rows)]):
        body = "\n".join(rows[a:b]).strip(_BLANK)
        if not body:
            continue
        if held and len(held) + 2 + len(body) > target:
            out.append((held_at, held))
            held = ""
        if len(body) > target:
            out += [(starts[a] + o, c) for o, c in by_paragraph(body, target, overlap)]
        else:
            held, held_at = (f"{held}\n\n{body}", held_at) if held else (body, starts[a])
    if held:
        out.append((held_at, held))
    return out or [(0, text.strip(_BLANK))]


def by_tail(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[Chunk]:
    """Paragraphs merged up to the target; a new buffer begins with the tail of the last one. Offsets aren't kept: 0."""
    out: list[str] = []
    held = ""
    for p in filter(None, (x.strip() for x in re.split(r"\n{2,}", text))):
        if held and len(held) + 1 + len(p) > target:
            out.append(held.strip())
            held = (held[-overlap:] if overlap else "") + "\n" + p
        else:
            held = f"{held}\n\n{p}" if held else p
    if held.strip():
        out.append(held.strip())
    return [(0, c) for c in out or [text.strip()]]


MODES = {"paragraph": by_paragraph, "legacy": by_paragraph, "section": by_section, "tail": by_tail}


def chunks_of(text: str | None, mode: str = "paragraph", target: int = TARGET, overlap: int = OVERLAP, lines: int = LINES, line_overlap: int = LINE_OVERLAP) -> list[Chunk]:
    if not text or not text.strip(_BLANK):
        return [(0, "")]
    return by_line(text, lines, line_overlap) if mode == "line" else MODES[mode](text, target, overlap)


def chunk(docs: DataFrame, mode: str | Column = "paragraph", text: str = "text", keep: list[str] | None = None, **sizes) -> DataFrame:
    """Columns `keep` with chunk_index, n_chunks, offset, chunk; mode may be a column (see mode_of)."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    d = docs.select(*keep, F.col(text).alias("__text"), (mode if isinstance(mode, Column) else F.lit(mode)).alias("__mode"))
    kind = pa.list_(pa.struct([("offset", pa.int32()), ("chunk", pa.string())]))
    out = d.select(*keep).withColumn("__chunks", F.lit(None).cast("array<struct<offset:int,chunk:string>>")).schema

    def run(batches):
        for b in batches:
            got = [[{"offset": o, "chunk": c} for o, c in chunks_of(t, m, **sizes)] for t, m in zip(b.column("__text").to_pylist(), b.column("__mode").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got, kind)], [*keep, "__chunks"])

    made = d.mapInArrow(run, out)
    return made.select(*keep, F.size("__chunks").alias("n_chunks"), F.posexplode("__chunks").alias("chunk_index", "__c")).select(*keep, "chunk_index", "n_chunks", "__c.offset", "__c.chunk")
