"""Conversations rendered by a compiled template (``chat_template``), with the spans that a model learns from.

Turns are dealt by (conversation, turn number // ``span``), sorted, and rendered as they stream by: one
shuffle of the text, and never a whole conversation in memory. A conversation of usual length is one row; a
longer one is several rows in order, ``part`` by ``part``, so no task holds it. What a template may know of
a turn's place (first, last, index) comes from counts per (conversation, span), which are added up before
they travel and put ahead of each span's turns.

``turn_digests`` reads rendered rows back: turns are found by their marks and unescaped, learnt text by its
spans. Rows that are a conversation are digested where they lie. Of longer ones, parsed parts go to one task
per conversation in order, which keeps running digests only; a digest of a whole cannot be split.

Edge cases: a null text or role counts as empty; a null conversation or turn number is a value of its own,
before all others; turns of one number are put in order of role and text and stay in one span; repeated rows
are turns of their own; an empty table gives no rows; further columns are ignored. Texts of any length are
taken whole.
"""

import hashlib
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm.chat_template import Template, Writer, unescape

# The format. Its marks are the control strings that texts must not hold.
CONTROLS = ("<turn", "</turn")
TURNS = """\
{%- for message in messages -%}
<turn {{ message.role | urlencode }}>
{% if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
</turn>
{% endfor -%}
"""
TURN = re.compile(r"<turn ([^>]*)>\n(.*?)</turn>\n", re.DOTALL)
#: Turn numbers in a span, and characters after which a part ends.
SPAN, PART_CHARS = 512, 1 << 20
RENDERED = "conv_id {}, span long, part int, whole boolean, text string, learnt array<struct<start:long,end:long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(
    turns: DataFrame,
    source: str = TURNS,
    controls=CONTROLS,
    constants: dict | None = None,
    span: int = SPAN,
    part_chars: int = PART_CHARS,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Rendered rows: conv_id, span, part, whole (the only row of its conversation), text, learnt.

    ``learnt`` has the spans of generation in code points of the row's own text. A conversation's text is
    that of its rows in order of span (null first) and part.
    """
    Template(source, controls, **(constants or {}))  # a template that the language refuses fails here
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.floor(F.col(turn) / F.lit(span)).cast("long").alias("span"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    in_order = Window.partitionBy("conv_id").orderBy(F.col("span").asc_nulls_first())
    places = (
        rows.groupBy("conv_id", "span")
        .count()
        .select(
            "conv_id",
            "span",
            F.coalesce(F.sum("count").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.lead(F.lit(True)).over(in_order).isNull().alias("ends"),
        )
    )
    # A span's place goes ahead of its turns.
    marked = places.select("conv_id", "span", F.lit(0).alias("kind"), "before", "ends").unionByName(
        rows.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    dealt = marked.repartition("conv_id", "span").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "span", "kind", F.col("turn").asc_nulls_first(), "role", "text"
    )
    known = dict(constants or {})

    def work(batches):
        template, span_of = Template(source, controls, **known), None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if span_of is not None:
                        done += span_of.end()
                    span_of = _Span(template, row, part_chars)
                else:
                    done += span_of.add(row)
            yield _batch(done, batch.schema.field("conv_id").type)
        if span_of is not None:
            yield _batch(span_of.end(), batch.schema.field("conv_id").type)

    return dealt.mapInArrow(work, RENDERED.format(rows.schema["conv_id"].dataType.simpleString()))


class _Span:
    """Turns of one span, rendered one behind: only when the next is seen is one known not to be the last."""

    def __init__(self, template: Template, place: dict, part_chars: int):
        self.template, self.part_chars = template, part_chars
        self.conv_id, self.span, self.at, self.ends = (place[k] for k in ("conv_id", "span", "before", "ends"))
        self.starts, self.part, self.held, self.out = self.at == 0, 0, None, Writer()
        if self.starts:
            template.head(self.out)

    def add(self, message: dict) -> list[tuple]:
        done = self._render(last=False)
        self.held = {"role": message["role"], "text": message["text"]}
        return done

    def end(self) -> list[tuple]:
        if self.held is not None:
            # The tail belongs to the last part, so that part is not closed before it.
            self.template.turn(self.held, self.at, self.ends, self.out)
        if self.ends:
            self.template.tail(self.out)
        return [self._row(whole=self.starts and self.ends and self.part == 0)]

    def _render(self, last: bool) -> list[tuple]:
        if self.held is None:
            return []
        self.template.turn(self.held, self.at, last, self.out)
        self.at += 1
        if self.out.size < self.part_chars:
            return []
        row = self._row(whole=False)
        self.part, self.out = self.part + 1, Writer()
        return [row]

    def _row(self, whole: bool) -> tuple:
        spans = [{"start": s, "end": e} for s, e in self.out.spans]
        return self.conv_id, self.span, self.part, whole, self.out.text(), spans


def _batch(rows: list[tuple], key) -> pa.RecordBatch:
    types = {"conv_id": key, "span": pa.int64(), "part": pa.int32(), "whole": pa.bool_(), "text": pa.string()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    arrays = [pa.array(c, t) for c, t in zip(columns, [*types.values(), SPANS], strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[*types, "learnt"])


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a text in the format ``TURNS``."""
    return [(unquote(role), unescape(body)) for role, body in TURN.findall(text)]


def learnt_text(text: str, spans) -> str:
    """All text under the spans, unescaped."""
    return "".join(unescape(text[s["start"] : s["end"]]) for s in spans)


PARSED = "conv_id {}, span long, part int, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"
DIGESTS = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def turn_digests(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from rows in the format ``TURNS``: number of turns, digest of role, line
    feed, text, line feed of every turn, code points and digest of the learnt text, code points as formatted."""
    key = rendered.schema["conv_id"].dataType.simpleString()
    whole = rendered.filter("whole").select("conv_id", "span", "part", "text", "learnt")
    parts = rendered.filter("not whole").select("conv_id", "span", "part", "text", "learnt").mapInArrow(_parsed, PARSED.format(key))
    in_order = parts.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("span").asc_nulls_first(), "part"
    )
    return whole.mapInArrow(_each, DIGESTS.format(key)).union(in_order.mapInArrow(_joined, DIGESTS.format(key)))


def _contents(text: str, spans) -> tuple[int, bytes, int, bytes, int]:
    turns, loss = read_turns(text), learnt_text(text, spans)
    return len(turns), "".join(f"{r}\n{t}\n" for r, t in turns).encode(), len(loss), loss.encode(), len(text)


def _parsed(batches):
    for batch in batches:
        rows = [_contents(r["text"], r["learnt"]) for r in batch.select(["text", "learnt"]).to_pylist()]
        types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * 5
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        names = ["conv_id", "span", "part", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names=names)


def _digest_batch(rows: list[tuple], key) -> pa.RecordBatch:
    types = (key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [()] * 6
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _each(batches):
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            n, turns, chars, loss, size = _contents(row["text"], row["learnt"])
            digests = hashlib.sha256(turns).hexdigest(), chars, hashlib.sha256(loss).hexdigest()
            done.append((row["conv_id"], n, *digests, size))
        yield _digest_batch(done, batch.schema.field("conv_id").type)


def _joined(batches):
    """Sorted parts to one row per conversation, by digests that are kept running."""
    at, state, key = None, None, None

    def closed():
        n, turns, chars, loss, size = state
        return at, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        key, done = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != at:
                if state is not None:
                    done.append(closed())
                at, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += row["n_turns"]
            state[1].update(row["turns"])
            state[2] += row["loss_chars"]
            state[3].update(row["loss"])
            state[4] += row["formatted_chars"]
        yield _digest_batch(done, key)
    if state is not None:
        yield _digest_batch([closed()], key)
