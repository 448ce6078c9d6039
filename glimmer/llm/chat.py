"""Chat formatting by schema fingerprints.

A record is a nested value.  The hash of its nested field paths (types left out)
selects one of the declared mappings, which turns prompt, instruction and message
layouts into canonical turns (role, text).  The template marks turns with control
strings; a backslash inside any control string of a text, and a doubled backslash for
each of the text's own, keep texts from ever containing one, and can be undone.
Everything is a SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SEP, END = "<|turn|>", "<|sep|>", "<|end|>\n"
#: Control strings of this and of other templates, cut after their first character.
CONTROL = r"(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])"
_TURNS = "array<struct<role:string,text:string>>"


def field_paths(record: Column) -> Column:
    """The nested field names of a record, without types: {a,b[{c>>>, each > closing the last
    bracket that is open, so that records of different nesting differ."""
    shape = F.regexp_replace(F.schema_of_variant(record), r"OBJECT<", "{")
    shape = F.regexp_replace(shape, r"ARRAY<", "[")
    shape = F.regexp_replace(shape, r": (?:STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|DATE|VARIANT|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|DECIMAL\([0-9]+,[0-9]+\))", "")
    return F.regexp_replace(shape, r"[: ]", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _value(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))


# Names that data sets give to the three roles.
_ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def _role(raw: Column) -> Column:
    out = raw
    for name, canonical in _ROLE_NAMES.items():
        out = F.when(raw == name, canonical).otherwise(out)
    return out


def _one(role: str, text: str, named=lambda c: c):
    return lambda r: F.array(_turn(named(_value(r, f"$.{role}")), _value(r, f"$.{text}")))


def _many(list_name: str, role: str, text: str):
    kind = f"array<struct<{role}:string,{text}:string>>"
    return lambda r: F.transform(F.coalesce(F.try_variant_get(r, f"$.{list_name}", kind), F.array().cast(kind)), lambda m: _turn(_role(F.coalesce(m[role], F.lit(""))), F.coalesce(m[text], F.lit(""))))


def _fields(*parts: tuple[str, str]):
    return lambda r: F.array(*[_turn(role, _value(r, f"$.{name}")) for role, name in parts])


def _instruction(r: Column) -> Column:
    more = _value(r, "$.input")
    asked = F.when(more == "", _value(r, "$.instruction")).otherwise(F.concat(_value(r, "$.instruction"), F.lit("\n\n"), more))
    return F.array(_turn("user", asked), _turn("assistant", _value(r, "$.output")))


#: Field paths (in the order of names) and the mapping of records that have them; role and text
#: are canonical already and stay as they are.
LAYOUTS = {
    "{role,text>": _one("role", "text"),
    "{content,role>": _one("role", "content", _role),
    "{from,value>": _one("from", "value", _role),
    "{messages[{content,role>>>": _many("messages", "role", "content"),
    "{conversations[{from,value>>>": _many("conversations", "from", "value"),
    "{turns[{role,text>>>": _many("turns", "role", "text"),
    "{completion,prompt>": _fields(("user", "prompt"), ("assistant", "completion")),
    "{prompt,response>": _fields(("user", "prompt"), ("assistant", "response")),
    "{answer,question>": _fields(("user", "question"), ("assistant", "answer")),
    "{prompt,response,system>": _fields(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    "{instruction,output>": _fields(("user", "instruction"), ("assistant", "output")),
    "{input,instruction,output>": _instruction,
}


def canonical_turns(record: Column, print_: Column) -> Column:
    """The turns of a record, by its fingerprint; null where no mapping is declared for it."""
    out = F.lit(None).cast(_TURNS)
    for paths, mapping in LAYOUTS.items():
        out = F.when(print_ == F.xxhash64(F.lit(paths)), mapping(record)).otherwise(out)
    return out


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1$3\\\\$2$4")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(records: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", record_col: str = "record") -> DataFrame:
    """One row per conversation: id, formatted, loss (array of (start, length) in code
    points of the assistant texts as formatted), n_unmapped.

    Records are ordered by ``order_col`` (nulls first), equal ones by role and text; a
    repeated record is a turn of its own.  Null roles and texts are empty.  A record of an
    undeclared layout adds no turn and is counted in ``n_unmapped``.  An empty table gives
    no rows; other columns are ignored.
    """
    rows = records.select(F.col(conv_col).alias("conv"), F.col(order_col).alias("ord"), F.col(record_col).alias("record"))
    rows = rows.withColumn("turns", canonical_turns(F.col("record"), fingerprint(F.col("record"))))
    each = rows.select("conv", "ord", F.posexplode_outer("turns").alias("pos", "t"))
    each = each.select(
        "conv", "ord", "pos", F.col("t.role").alias("role"), F.col("t.text").alias("text"),
        F.concat(F.lit(TURN), escaped(F.col("t.role")), F.lit(SEP)).alias("head"), escaped(F.col("t.text")).alias("body"),
    ).withColumn("size", F.coalesce(F.char_length("head") + F.char_length("body") + len(END), F.lit(0)).cast("long"))
    order = Window.partitionBy("conv").orderBy("ord", "pos", "role", "text")
    each = each.withColumn("n", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.char_length("head"))
    turn = F.when(F.col("head").isNotNull(), F.struct("n", "role", "start", F.char_length("body").cast("long").alias("length"), F.concat("head", "body", F.lit(END)).alias("shown")))
    grouped = each.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum(F.col("head").isNull().cast("long")).alias("n_unmapped"))
    loss = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return grouped.select(F.col("conv").alias(conv_col), F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), loss.alias("loss"), "n_unmapped")


def parsed_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, r"<\|turn\|>", -1)

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"<\|sep\|>", -1)
        tail = F.element_at(halves, 2)
        return _turn(unescaped(F.element_at(halves, 1)), unescaped(F.left(tail, F.char_length(tail) - len(END))))

    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
