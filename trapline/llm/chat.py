"""Chat formatting in DataFrame functions only: records of several layouts become turns, turns become one marked text with a loss mask.

A record is a struct of nullable parts or a JSON object. The hash of the sorted nested field paths that it holds selects a mapping; extra
fields make another fingerprint, so a layout with them needs its own mapping. A record that no mapping fits, that is null or that is not
JSON has null turns and is not formatted.

* Structs: a part is held if it is not null, and a list of messages holds the paths of its members' fields, also where it is empty. Only
  Spark's 2 GB for a value bound them. Null fields of a message are empty.
* JSON: every field that is written is held, null or not. A list of messages that is empty or null gives zero turns. A record too large to
  be read (128 MiB as Variant, or a single string above Jackson's bound) is an error, never null.

Rows by turn become structs first (``records_of``): a user's turn and an assistant's are a prompt and its response, the same after a
system turn a question with its answer, and all else is a list of messages.

Template: ``<s>``, then for each turn ``[INST]role[/INST]text</s>``. Inside roles and texts every control string (``<s>``, ``</s>``,
``[INST]``, ``[/INST]``) gets a backslash after its first character, one more where there are some already, so that every text can be
read back exactly. Null roles and texts are empty. Turns of equal number are ordered by role and text, null numbers come first.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from trapline.llm.shared import free_name

START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
TURNS = "array<struct<role:string,text:string>>"
#: Strings of any length; Spark's own bound is 20,000,000 characters.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}
#: Bytes from which a record may be too large for Variant's parser, whose first bound is a string's length.
LARGE = 20_000_000


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: either a list of messages with fields for role and text, or fields with a fixed role each."""

    name: str
    messages: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    extra: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict, hash=False)

    def names(self) -> list[str]:
        return [self.messages] if self.messages else sorted({n for part, _ in self.fields for n in part.split("+")})

    def paths(self) -> list[str]:
        """Nested field paths of a struct of this layout."""
        own = [f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"] if self.messages else self.names()
        return sorted([*own, *self.extra])

    def shapes(self) -> list[str]:
        """Shapes of a JSON object of this layout; the second is that of a list of messages which is empty or null."""
        return [self.shape()] + ([f"OBJECT<{', '.join(sorted([self.messages, *self.extra]))}>"] if self.messages else [])

    def shape(self) -> str:
        names = {n: n for part, _ in self.fields for n in part.split("+")} | {n: n for n in self.extra}
        if self.messages:
            names[self.messages] = f"{self.messages}: ARRAY<OBJECT<{', '.join(sorted([self.role, self.text]))}>>"
        return f"OBJECT<{', '.join(names[n] for n in sorted(names))}>"


#: Known layouts. ``a+b`` joins two fields by an empty line where the second has text.
MAPPINGS = (
    Mapping("messages", messages="messages", role="role", text="content"),
    Mapping("shared", messages="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", fields=(("instruction+input", "user"), ("output", "assistant"))),
    Mapping("short instruction", fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("prompt", fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("question", fields=(("system", "system"), ("question", "user"), ("answer", "assistant"))),
)


def shape_of(record: Column) -> Column:
    """Nested field names of a JSON object, sorted at each level, lists marked; types of plain fields left out. Null if it is no JSON, an
    error if it is an object too large for Variant."""
    parsed = F.try_parse_json(record)
    lost = parsed.isNull() & (F.octet_length(record) >= LARGE) & F.from_json(record, "map<string,string>", ANY_LENGTH).isNotNull()
    too_large = F.raise_error(F.concat(F.lit("a record is too large for Variant, bytes: "), F.octet_length(record).cast("string"))).cast("string")
    return F.when(lost, too_large).otherwise(F.regexp_replace(F.schema_of_variant(parsed), r": (?!ARRAY<OBJECT|OBJECT)[A-Z]+(<[A-Z]+>|\([0-9,]+\))?", ""))


def fingerprint(shape: Column) -> Column:
    return F.sha2(shape, 256)


def fingerprint_of(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()


def paths_of(record: Column, kind: StructType, prefix: str = "") -> list[Column]:
    """The paths of a struct's parts, each null where the part is null."""
    found = []
    for part in kind.fields:
        value, path = record[part.name], prefix + part.name
        inner = part.dataType.elementType if isinstance(part.dataType, ArrayType) else part.dataType
        if not isinstance(inner, StructType):
            found.append(F.when(value.isNotNull(), F.lit(path)))
        elif inner is part.dataType:
            found += paths_of(value, inner, f"{path}.")
        else:
            found += [F.when(value.isNotNull(), F.lit(f"{path}[].{f.name}")) for f in inner.fields]
    return found


def path_fingerprint(record: Column, kind: StructType) -> Column:
    """Hash of the sorted paths that a struct holds; null for a null struct."""
    return F.when(record.isNotNull(), fingerprint(F.array_join(F.array_sort(F.array_compact(F.array(*paths_of(record, kind)))), "\n")))


def message_turns(listed: Column, mapping: Mapping) -> Column:
    def turn(x):
        role = F.coalesce(x[mapping.role], F.lit(""))
        for old, new in mapping.roles.items():
            role = F.when(x[mapping.role] == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(x[mapping.text], F.lit("")).alias("text"))

    return F.transform(listed, turn)


def field_turns(values: Column, mapping: Mapping) -> Column:
    turns = []
    for part, role in mapping.fields:
        first, *rest = [F.coalesce(values[n], F.lit("")) for n in part.split("+")]
        for more in rest:
            first = F.when(more != "", F.concat(first, F.lit("\n\n"), more)).otherwise(first)
        turns.append(F.struct(F.lit(role).alias("role"), first.alias("text")))
    return F.array(*turns)


def mapped(record: Column, mapping: Mapping) -> Column:
    """Turns of a JSON record under one mapping."""
    if mapping.messages:
        listed = F.from_json(record, f"`{mapping.messages}` array<struct<`{mapping.role}`:string,`{mapping.text}`:string>>", ANY_LENGTH)[mapping.messages]
        nothing = F.coalesce(F.get_json_object(record, f"$.{mapping.messages}"), F.lit("[]")) == "[]"
        return F.when(nothing, F.expr(f"cast(array() as {TURNS})")).otherwise(message_turns(listed, mapping))
    return field_turns(F.from_json(record, ",".join(f"`{n}` string" for n in mapping.names()), ANY_LENGTH), mapping)


def chosen(records: DataFrame, found: Column, cases: list[tuple[str, list[str], Column]]) -> DataFrame:
    """``records`` with ``fingerprint``, and ``layout`` and ``turns`` of the case that has it among its fingerprinted texts."""
    known = records.withColumn("fingerprint", found)
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for name, texts, own in cases:
        same = F.col("fingerprint").isin([fingerprint_of(t) for t in texts])
        turns, layout = F.when(same, own).otherwise(turns), F.when(same, name).otherwise(layout)
    return known.withColumns({"layout": layout, "turns": turns})


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records``, structs or JSON, with ``fingerprint``, ``layout`` and ``turns``; these replace columns of the same name."""
    kind, own = records.schema[record].dataType, F.col(record)
    if not isinstance(kind, StructType):
        return chosen(records, fingerprint(shape_of(own)), [(m.name, m.shapes(), mapped(own, m)) for m in mappings])
    fits = [m for m in mappings if set(m.names()) <= set(kind.names)]
    cases = [(m.name, ["\n".join(m.paths())], message_turns(own[m.messages], m) if m.messages else field_turns(own, m)) for m in fits]
    return chosen(records, path_fingerprint(own, kind), cases)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2"), r"\[(\\*)(/?INST\])", r"\[\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[\\(\\*)(/?INST\])", r"\[$1$2"), r"<\\(\\*)(/?s>)", r"<$1$2")


def formatted(conversations: DataFrame, turns: str = "turns", learn_role: str = "assistant") -> DataFrame:
    """``conversations`` with ``formatted`` and ``loss``, the spans {start, length} in code points from 1 that hold texts of ``learn_role``;
    they replace columns of the same name, all others stay."""
    name = free_name(conversations, "ready")
    ready = F.transform(F.col(turns), lambda x: F.struct((x["role"] == learn_role).alias("learn"), F.concat(F.lit(OPEN), escaped(x["role"]), F.lit(CLOSE)).alias("head"), escaped(x["text"]).alias("body")))
    text = F.concat(F.lit(START), F.array_join(F.transform(F.col(name), lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""))
    start = F.struct(F.lit(len(START) + 1).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,length:long>>)").alias("spans"))

    def step(done, x):
        begin, length = done["at"] + F.length(x["head"]), F.length(x["body"]).cast("long")
        spans = F.when(x["learn"], F.concat(done["spans"], F.array(F.struct(begin.alias("start"), length.alias("length"))))).otherwise(done["spans"])
        return F.struct((begin + length + len(END)).alias("at"), spans.alias("spans"))

    return conversations.withColumn(name, ready).withColumns({"formatted": text, "loss": F.aggregate(name, start, step, lambda x: x["spans"])}).drop(name)


def turns_back(text: Column) -> Column:
    """Turns of a formatted text."""
    parts = F.split(F.substring(text, len(START) + 1, 2**31 - 1), END, -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    split_at = lambda x: F.instr(x, CLOSE)
    return F.transform(
        whole,
        lambda x: F.struct(
            unescaped(F.substring(x, F.lit(len(OPEN) + 1), split_at(x) - len(OPEN) - 1)).alias("role"),
            unescaped(F.substring(x, split_at(x) + len(CLOSE), F.lit(2**31 - 1))).alias("text"),
        ),
    )


def loss_texts(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(loss, lambda x: unescaped(F.substring(text, x["start"].cast("int"), x["length"].cast("int"))))


def listed_turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): rows by turn as one array for each conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))))
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(listed.alias("listed"))
    return grouped.select("conv_id", F.transform("listed", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def records_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record): rows by turn as one struct for each conversation, in the layout that its roles make."""
    said = F.col("turns")["text"]
    roles = F.transform("turns", lambda x: x["role"])
    of = lambda *names: roles == F.array(*map(F.lit, names))
    pair, triple = of("user", "assistant"), of("system", "user", "assistant")
    messages = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    parts = [F.when(~pair & ~triple, messages).alias("messages")]
    parts += [F.when(pair, said[n]).alias(name) for n, name in enumerate(("prompt", "response"))]
    parts += [F.when(triple, said[n]).alias(name) for n, name in enumerate(("system", "question", "answer"))]
    return listed_turns(rows, conv_id, turn, role, text).select("conv_id", F.struct(*parts).alias("record"))


def turns_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, fingerprint, layout, turns): rows by turn, read through the mapping that fits each conversation's struct."""
    return canonical(records_of(rows, conv_id, turn, role, text), "record", mappings).drop("record")
