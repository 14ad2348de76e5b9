"""Chat records of any known layout as canonical turns and as one marked-up training text.

A record's layout is the hash of its paths of fields that some layout uses, without types; other fields are
not looked into. It selects a declarative mapping to turns. The template marks turns with
control strings; in roles and texts a backslash becomes ``\\b`` and ``<|`` becomes ``\\l``, so no
control string can appear inside a text and ``read_back`` restores every text exactly.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"
#: Scalar types in a variant's schema string.
SCALAR = r"(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|DECIMAL\(\d+, ?\d+\))"
#: Field names that some layout uses.
FIELDS = ("completion", "content", "conversations", "from", "input", "instruction", "messages", "output", "prompt",
          "response", "role", "text", "value", "question", "answer")
#: Fields that hold a list of turns.
LISTS = ("messages", "conversations")
#: Speakers' names that mean a canonical role.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def _get(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit(""))


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))


def _pair(user: str, assistant: str):
    return lambda r: F.array(_turn("user", _get(r, user)), _turn("assistant", _get(r, assistant)))


def _instruction(r: Column) -> Column:
    more = _get(r, "input")
    asked = F.when(more == "", _get(r, "instruction")).otherwise(F.concat(_get(r, "instruction"), F.lit("\n\n"), more))
    return F.array(_turn("user", asked), _turn("assistant", _get(r, "output")))


def _messages(field: str, role: str, text: str):
    def turns(r: Column) -> Column:
        rows = F.try_variant_get(r, f"$.{field}", f"array<struct<`{role}`:string,`{text}`:string>>")
        spoken = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        return F.coalesce(F.transform(rows, lambda m: _turn(
            F.coalesce(spoken[m[role]], m[role], F.lit("")), F.coalesce(m[text], F.lit("")))), F.array().cast(TURNS))
    return turns


#: Layout -> (shape of its field paths, mapping to turns).
LAYOUTS = {
    "turn": ("OBJECT<role,text>", lambda r: F.array(_turn(_get(r, "role"), _get(r, "text")))),
    "prompt_response": ("OBJECT<prompt,response>", _pair("prompt", "response")),
    "prompt_completion": ("OBJECT<completion,prompt>", _pair("prompt", "completion")),
    "question_answer": ("OBJECT<answer,question>", _pair("question", "answer")),
    "instruction": ("OBJECT<instruction,output>", _pair("instruction", "output")),
    "instruction_input": ("OBJECT<input,instruction,output>", _instruction),
    "messages": ("OBJECT<messages:ARRAY<OBJECT<content,role>>>", _messages("messages", "role", "content")),
    "conversations": ("OBJECT<conversations:ARRAY<OBJECT<from,value>>>", _messages("conversations", "from", "value")),
}


def _paths(fields: Column, lists: dict[str, Column]) -> Column:
    """Names of the used fields of a map of variants; ``:OTHER`` follows one that is neither scalar nor among ``lists``."""
    def path(name: Column) -> Column:
        scalar = F.coalesce(F.schema_of_variant(fields[name]), F.lit("VOID")).rlike(f"^{SCALAR}$")
        out = F.when(scalar, name)
        for field, inner in lists.items():
            out = out.when(name == field, F.concat(name, F.coalesce(inner, F.lit(":OTHER"))))
        return out.otherwise(F.concat(name, F.lit(":OTHER")))
    return F.transform(F.filter(F.map_keys(fields), lambda k: k.isin(*FIELDS)), path)


def _object(paths: Column) -> Column:
    return F.concat(F.lit("OBJECT<"), F.array_join(F.array_sort(F.array_distinct(paths)), ","), F.lit(">"))


def _list_shape(record: Column, field: str) -> Column:
    """Shape of an array of objects and nulls, over all elements; else null."""
    kind = "map<string,variant>"
    rows = F.filter(F.try_variant_get(record, f"$.{field}", "array<variant>"), lambda x: F.schema_of_variant(x) != "VOID")
    rows = F.transform(rows, lambda x: F.try_variant_get(x, "$", kind))
    inner = F.flatten(F.transform(rows, lambda m: _paths(m, {})))
    return F.concat(F.lit(":ARRAY<"), _object(inner), F.lit(">"))


def shape(record: Column) -> Column:
    """Paths of a variant's used fields: names in order, scalars without type. Fields that no layout uses are left out,
    whatever they hold."""
    return _object(_paths(F.try_variant_get(record, "$", "map<string,variant>"), {f: _list_shape(record, f) for f in LISTS}))


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with ``layout``, its ``fingerprint``, and ``turns`` (array of role and text).

    ``record`` is a variant, or a JSON string. Null, broken and unknown records get a null layout and no
    turns; missing and null fields are empty texts. Columns of these three names are replaced; no row is
    dropped.
    """
    kind = records.schema[record].dataType.typeName()
    value = F.try_parse_json(F.col(record)) if kind == "string" else F.col(record)
    found = records.withColumn("_record", value).withColumn("fingerprint", F.xxhash64(shape(F.col("_record"))))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for name, (paths, mapping) in LAYOUTS.items():
        same = F.col("fingerprint") == F.xxhash64(F.lit(paths))
        layout = F.when(same, F.lit(name)).otherwise(layout)
        turns = F.when(same, mapping(F.col("_record")).cast(TURNS)).otherwise(turns)
    return found.withColumn("layout", layout).withColumn("turns", turns).drop("_record")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def format_chats(
    turns: DataFrame, conversation: str, order: Sequence[str], role: str = "role", text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conversation``, ``formatted`` and ``loss_spans`` (start, length in code points).

    ``turns`` has a row per turn; equal ``order`` values are ordered by role and text, null order values
    come first, null roles and texts are empty, rows with a null conversation form one conversation.
    A conversation is one value of the result, so its turns meet in one row; nothing else does.
    """
    lead = F.concat(F.lit(TURN), escaped(F.col("_role")), F.lit(TEXT))
    keyed = turns.select(
        F.col(conversation).alias("_conv"), F.struct(*order, F.col(role).alias("_r"), F.col(text).alias("_t")).alias("_at"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    pieces = keyed.select(
        "_conv", "_at", lead.alias("_lead"), escaped(F.col("_text")).alias("_body"),
        (F.col("_role") == loss_role).alias("_loss"))
    pieces = pieces.withColumn("_size", F.length("_lead") + F.length("_body") + F.lit(len(END)))
    before = Window.partitionBy("_conv").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    grouped = placed.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct(
        "_start", F.concat("_lead", "_body", F.lit(END)).alias("piece"), "_loss",
        (F.col("_start") + F.length("_lead")).alias("from"), F.length("_body").cast("long").alias("size")))).alias("_turns"))
    return grouped.select(
        F.col("_conv").alias(conversation),
        F.array_join(F.transform("_turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("_turns", lambda t: t["_loss"]), lambda t: F.struct(
            t["from"].alias("start"), t["size"].alias("length"))).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of role and text."""
    pieces = F.filter(F.split(formatted, r"\Q" + TURN + r"\E"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, TEXT, 1)
        body = F.substring(piece, F.length(head) + F.lit(len(TEXT) + 1), F.length(piece))
        return _turn(unescaped(head), unescaped(F.substring(body, F.lit(1), F.length(body) - F.lit(len(END)))))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss spans, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
