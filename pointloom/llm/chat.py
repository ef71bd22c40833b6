"""Chat formatting: heterogeneous records to one reversible template.

Layouts are recognised by a fingerprint, the hash of the sorted nested field
paths of a record; the fingerprint selects a declarative mapping to canonical
turns ``array<struct<role, text>>``.  Records are JSON strings or variants of
any layout (prompt and response, instruction and input, lists of messages), or
rows by turn, which never pass through JSON: its parser refuses long strings.
Everything is a SQL expression.

Template: for each turn ``<|role|>ROLE\\nTEXT<|end|>\\n``.  In role and text a
backslash becomes two and ``<`` becomes backslash + ``l``; so no ``<`` of an
input reaches the output, markers cannot be forged, and unescaping gives back
every character.  A newline in a role becomes backslash + ``n``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|role|>", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"
PROBE = "\\### Assistant: </turn> ok"
#: The JSON parser refuses strings of more characters; no shorter record makes a variant over its limit.
LONG = 20_000_000


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``paths``: the leaf paths that identify the layout.  ``items``: path of a
    list of messages with ``role`` and ``text`` fields, or None; ``fixed``: else
    (role, path or paths joined by a blank line) of each turn.
    """

    paths: tuple[str, ...]
    items: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


MAPPINGS = [
    Mapping(("messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping(("messages[].role", "messages[].text"), "messages", "role", "text"),
    Mapping(("messages[].content", "messages[].role", "system"), "messages", "role", "content", (("system", ("system",)),)),
    Mapping(("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping(("conversation[].from", "conversation[].value"), "conversation", "from", "value"),
    Mapping(("completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "response", "system"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("answer", "question"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping(("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("input", "instruction", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
]

#: Names of the same role in layouts whose role field is not called ``role``.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: Column) -> Column:
    """Hash of a sorted list of nested field paths."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"), 256)


def field_paths(record: Column) -> Column:
    """Leaf paths of a variant that is an object of scalars or of lists of objects.

    Deeper nesting shows as the path of its top; it then matches no mapping.
    """
    fields = F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))
    below = lambda name: F.try_variant_get(F.map_values(F.map_filter(F.try_variant_get(record, "$", "map<string,variant>"), lambda k, _: k == name))[0], "$", "array<map<string,variant>>")

    def leaves(name: Column) -> Column:
        inner = F.flatten(F.transform(F.filter(below(name), lambda m: m.isNotNull()), lambda m: F.map_keys(m)))
        return F.when(F.size(F.coalesce(below(name), F.array())) > 0, F.transform(inner, lambda k: F.concat(name, F.lit("[]."), k))).otherwise(F.array(name))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce(fields, F.array()), leaves))))


def canonical_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for name, means in ROLES.items():
        out = F.when(F.coalesce(role, F.lit("")) == name, means).otherwise(out)
    return out


def turns_of(record: Column, key: Column, mappings: list[Mapping] | None = None) -> Column:
    """Canonical turns of a variant, by its fingerprint; null for unknown layouts."""
    chosen = F.lit(None).cast(TURNS)
    get = lambda v, path: F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))

    def listed(record: Column, m: Mapping) -> Column:
        role = (lambda v: get(v, "role")) if m.role == "role" else (lambda v: canonical_role(get(v, m.role)))
        return F.transform(F.coalesce(F.try_variant_get(record, f"$.{m.items}", "array<variant>"), F.array()), lambda v: turn(role(v), get(v, m.text)))

    for m in MAPPINGS if mappings is None else mappings:
        head = [turn(F.lit(role), F.array_join(F.filter(F.array(*(get(record, p) for p in paths)), lambda x: x != ""), "\n\n")) for role, paths in m.fixed]
        turns = F.array(*head) if head else F.array().cast(TURNS)
        if m.items:
            turns = F.concat(turns, listed(record, m))
        print_of = fingerprint(F.array(*map(F.lit, m.paths)))
        chosen = F.when(key == print_of, turns).otherwise(chosen)
    return chosen


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def loss_spans(turns: Column, learn: str = "assistant") -> Column:
    """``array<struct<start, length>>`` (characters of the formatted text, start from 0): the learnt turns' escaped texts."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + len(OPEN) + F.length(F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n"))) + 1
        size = F.length(escape(t["text"]))
        span = F.array(F.struct(start.cast("int").alias("start"), size.cast("int").alias("length")))
        return F.struct((start + size + len(CLOSE)).cast("int").alias("at"), F.when(t["role"] == learn, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, state, step)["spans"]


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
        line = F.position(F.lit("\n"), body)
        return F.struct(unescape(F.substring(body, F.lit(1), line - 1)).alias("role"), unescape(F.substring(body, line + 1, F.length(body))).alias("text"))

    return F.transform(pieces, one)


def format_turns(df: DataFrame, turns: str = "turns", learn: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans``, or replace them; null turns give an empty text without spans."""
    known = F.coalesce(F.col(turns), F.array().cast(TURNS))
    return df.withColumn("formatted", render(known)).withColumn("loss_spans", loss_spans(known, learn))


def format_records(df: DataFrame, record: str = "record", mappings: list[Mapping] | None = None, learn: str = "assistant") -> DataFrame:
    """Format JSON records (strings) of any mix of layouts.

    Adds ``fingerprint``, ``turns`` (null where no mapping has the fingerprint or
    the JSON is malformed or null), ``formatted`` and ``loss_spans``.  A record of
    more than ``LONG`` characters that the parser refuses, for its size or as
    malformed, is an error: it must not pass for an empty conversation.  Input
    columns of the added names are replaced; others stay, whatever their names.
    Repeated rows each have their result.
    """
    parsed = "_" * (1 + max(map(len, df.columns)))  # longer than any column's name
    value = F.when(F.length(record) > LONG, F.parse_json(F.col(record))).otherwise(F.try_parse_json(F.col(record)))
    out = df.withColumn(parsed, value).withColumn("fingerprint", fingerprint(field_paths(F.col(parsed))))
    out = out.withColumn("turns", turns_of(F.col(parsed), F.col("fingerprint"), mappings))
    return format_turns(out.drop(parsed), "turns", learn)


def turns_of_messages(messages: Column, fields: tuple[str, ...], mappings: list[Mapping] | None = None) -> tuple[Column, Column]:
    """Fingerprint and canonical turns of an array of structs of string ``fields``, a record that has it as ``messages``."""
    paths = tuple(sorted(f"messages[].{f}" for f in fields))
    found = [m for m in (MAPPINGS if mappings is None else mappings) if m.items == "messages" and tuple(sorted(m.paths)) == paths]
    turns = F.lit(None).cast(TURNS)
    if found:
        m = found[-1]
        role = (lambda v: v["role"]) if m.role == "role" else (lambda v: canonical_role(v[m.role]))
        turns = F.transform(messages, lambda v: F.struct(role(v).alias("role"), v[m.text].alias("text")))
    return fingerprint(F.array(*map(F.lit, paths))), turns


def format_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", mappings: list[Mapping] | None = None, learn: str = "assistant") -> DataFrame:
    """Format each conversation of rows by turn: ``conv_id`` and the columns of :func:`format_records`.

    Turns are ordered by turn, then role, then text (null first, as empty); so
    repeated rows and ties have one defined order.  Null conv_id is one more
    conversation.
    """
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    gathered = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(item)).alias("_m"))
    key, turns = turns_of_messages(F.col("_m"), ("role", "content"), mappings)
    return format_turns(gathered.select("conv_id", key.alias("fingerprint"), turns.alias("turns")), "turns", learn)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, with digests read back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    out = format_rows(rows.unionByName(probe))
    back = parse(F.col("formatted"))
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return (
        out.withColumn("back", back)
        .withColumn("learnt", learnt)
        .select(
            "conv_id",
            F.size("back").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("learnt").cast("long").alias("loss_chars"),
            F.sha2("learnt", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), esc AS (
  SELECT *, replace(replace(text, '\', '\\'), '<', '\l') AS body FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(body) + 17) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""
