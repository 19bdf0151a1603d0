"""Chat formatting by schema fingerprints.

Records come as JSON. The set of a record's nested field paths, with [] for list elements, is hashed to a fingerprint; a registry
gives each fingerprint a declarative mapping to canonical turns. Turns are written with a template whose control strings
are escaped, reversibly, wherever they occur inside a role or a text, and are read back from the formatted string alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as c

#: The template's own marks.
BEGIN, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common chat templates, which a text must not bring in either.
CONTROL = [BEGIN, MIDDLE, END, "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>", "<unk>", "<pad>"]
#: Put after the first character of a control string inside a text; doubled where a text has it itself.
MARK = "\\"

TURNS = "array<struct<role:string,text:string>>"
#: Layouts that conversations_as_records deals out to conversations that aren't one prompt and its answer.
LIST_LAYOUTS = 5


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; a value that is null or scalar ends a path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in (paths(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}") or {at})} or {f"{at}{{}}"}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    rows: path of a list of messages with `role` and `text` fields, themselves paths inside a message; or fixed: (role,
    field or fields joined by a blank line) in order, empty ones left out. roles renames roles.
    """

    name: str
    fields: tuple[str, ...]
    rows: tuple[str, ...] = ()
    role: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict = field(default_factory=dict, hash=False)

    def turns(self, record: dict) -> list[tuple[str, str]]:
        s = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        if self.rows:
            into = lambda v, keys: into(v.get(keys[0]), keys[1:]) if keys and isinstance(v, dict) else v
            found = [(s(into(m, self.role)), s(into(m, self.text))) for m in into(record, self.rows) or [] if isinstance(m, dict)]
            return [(self.roles.get(role, role), text) for role, text in found]
        out = []
        for role, keys in self.fixed:
            text = "\n\n".join(x for k in keys if (x := s(record.get(k))))
            if text:
                out.append((role, text))
        return out


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Layouts by their field paths. A further layout is a further row.
MAPPINGS = (
    Mapping("messages", ("/messages[]/role", "/messages[]/content"), rows=("messages",), role=("role",), text=("content",)),
    Mapping("turns", ("/turns[]/role", "/turns[]/text"), rows=("turns",), role=("role",), text=("text",)),
    Mapping("authored parts", ("/conversation[]/author/role", "/conversation[]/content/text"), rows=("conversation",), role=("author", "role"), text=("content", "text")),
    Mapping("shared conversation", ("/conversations[]/from", "/conversations[]/value"), rows=("conversations",), role=("from",), text=("value",), roles=_SPEAKERS),
    Mapping("chat messages", ("/chat/messages[]/speaker", "/chat/messages[]/utterance"), rows=("chat", "messages"), role=("speaker",), text=("utterance",), roles=_SPEAKERS),
    Mapping("instruction", ("/instruction", "/input", "/output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction without input", ("/instruction", "/output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("prompt and completion", ("/prompt", "/completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", ("/prompt", "/response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system, prompt and response", ("/system", "/prompt", "/response"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", ("/question", "/answer"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(set(m.fields)): m for m in mappings}


def canonical(records: DataFrame, *, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """`records` with fingerprint, layout and turns (array of role and text).

    A record whose fingerprint has no mapping, that is null or not a JSON object gets a null layout and null turns, so it
    can be counted and looked at; nothing is guessed. Null roles and texts become empty. Other columns pass through.
    """
    known = registry(mappings)
    schema = records.drop("fingerprint", "layout", "turns").schema
    names = list(schema.names)
    out = StructType(list(schema.fields)).add("fingerprint", "string").add("layout", "string")
    out = out.add("turns", records.sparkSession.createDataFrame([], f"t {TURNS}").schema[0].dataType)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in c.slices(whole, record, 4 << 20):
                marks, layouts, turns = [], [], []
                for raw in batch.column(record).to_pylist():
                    try:
                        value = json.loads(raw) if raw is not None else None
                    except ValueError:
                        value = None
                    mark = fingerprint(paths(value)) if isinstance(value, dict) else None
                    m = known.get(mark)
                    marks.append(mark)
                    layouts.append(m.name if m else None)
                    turns.append([{"role": r, "text": t} for r, t in m.turns(value)] if m else None)
                yield pa.record_batch([*[batch.column(x) for x in names], pa.array(marks, pa.string()), pa.array(layouts, pa.string()), pa.array(turns, kind)], names=[*names, "fingerprint", "layout", "turns"])

    return records.select(*names).mapInArrow(run, out)


def _pattern(control: list[str]) -> str:
    """The first character of each control string, at every place where one begins."""
    return "(?s)(?=" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}<>/!-])", r"\\\1", x).replace(r"\<", "<").replace(r"\>", ">").replace(r"\/", "/").replace(r"\!", "!") for x in control) + ")(.)"


def escape(text: Column, control: list[str] = CONTROL) -> Column:
    """`text` without any control string; unescape() gives it back."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(MARK * 2))
    return F.regexp_replace(doubled, _pattern(control), r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(\\)|\\", "$1")


def render(turns: Column, control: list[str] = CONTROL) -> Column:
    """One string for an array of turns."""
    one = lambda t: F.concat(F.lit(BEGIN), escape(t["role"], control), F.lit(MIDDLE), escape(t["text"], control), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, read back: array of role and text (unescaped), skip (where the
    escaped text begins after BEGIN) and length (of the escaped text)."""
    bodies = F.filter(F.split(formatted, BEGIN.replace("|", r"\|"), -1), lambda x, i: i > 0)
    def turn(x: Column) -> Column:
        role = F.substring_index(x, MIDDLE, 1)
        text = F.substring_index(x, END, 1)
        inner = F.call_function("substring", text, F.length(role) + len(MIDDLE) + 1)
        return F.struct(unescape(role).alias("role"), unescape(inner).alias("text"), (F.length(role) + len(MIDDLE)).alias("skip"), F.length(inner).alias("length"))

    return F.transform(bodies, turn)


def format_turns(df: DataFrame, *, turns: str = "turns", control: list[str] = CONTROL, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """`df` with formatted, parsed (the turns read back from it) and loss_spans (start, length in code points).

    The loss mask covers the escaped texts of turns of `loss_roles`, not their marks. Null or empty turns: an empty string.
    """
    out = df.drop("formatted", "parsed", "loss_spans").withColumn("formatted", render(F.coalesce(F.col(turns), F.array().cast(TURNS)), control))
    out = out.withColumn("parsed", parse(F.col("formatted")))
    around = len(BEGIN) + len(END) + 1
    walked = F.aggregate(
        F.col("parsed"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,start:int,length:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + t["skip"] + t["length"] + around).alias("at"),
            F.concat(a["spans"], F.array(F.struct(t["role"].alias("role"), (a["at"] + len(BEGIN) + t["skip"]).cast("int").alias("start"), t["length"].cast("int").alias("length")))).alias("spans"),
        ),
    )["spans"]
    mine = F.filter(walked, lambda s: s["role"].isin(*loss_roles))
    return out.withColumn("loss_spans", F.transform(mine, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))))


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows (conv_id, turn, role, text) gathered into one JSON record for each conversation.

    Records are as heterogeneous as those of real sources: one user and one assistant turn with texts make a prompt and
    response or an instruction record, other conversations lists of messages in five layouts, dealt out by conv_id. Layouts
    that rename speakers are left to conversations that have none of the renamed names, so that each turn comes back as it was.
    Turns are in order of turn, role, text (nulls first); repeated rows are all kept. A conversation is one value, as its
    formatted string has to be; rows with a null conv_id form one conversation.
    """
    each = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("t"))
    listed = lambda role, text: F.transform("t", lambda x: F.struct(x["role"].alias(role), x["text"].alias(text)))
    record = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    nested = lambda name, v: F.struct(v.alias(name))
    parts = F.transform("t", lambda x: F.struct(nested("role", x["role"]).alias("author"), nested("text", x["text"]).alias("content")))
    side = lambda k: F.get("t", k)
    pair = (F.size("t") == 2) & (side(0)["role"] == "user") & (side(1)["role"] == "assistant") & (side(0)["text"] != "") & (side(1)["text"] != "")
    renamed = F.exists("t", lambda x: x["role"].isin(*_SPEAKERS))
    deal = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(LIST_LAYOUTS))
    even = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(2)) == 0
    made = (
        F.when(pair & even, record(prompt=side(0)["text"], response=side(1)["text"]))
        .when(pair, record(instruction=side(0)["text"], output=side(1)["text"]))
        .when(deal == 1, record(turns=listed("role", "text")))
        .when(deal == 2, record(conversation=parts))
        .when((deal == 3) & ~renamed, record(conversations=listed("from", "value")))
        .when((deal == 4) & ~renamed, record(chat=nested("messages", listed("speaker", "utterance"))))
        .otherwise(record(messages=listed("role", "content")))
    )
    return t.select("conv_id", made.alias("record"))
