"""Chat formatting by schema fingerprints, in SQL functions alone.

Records come in many layouts: rows by turn, lists of messages, prompt and
completion, instruction with input and output. The fingerprint of a record is
a 64-bit hash of the nested field paths that it has; for each mapping, the hash
of those of the paths that the mapping knows is looked up, and the first hit
selects the declarative mapping, which turns the record into canonical turns
(id, record, place, role, text). For a table of columns the paths come from its
schema, for JSON records from each record: all its keys, those of null values
and of any element of a list too, so a field more than a mapping knows of, or a
null, takes no turn away.

Roles of rows by turn are taken as they are; those of other layouts get the
canonical names of ROLES.

The template marks turns as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles
and texts each `<`, backslashes, `|` gets one more backslash, so no control
string can occur there, and taking one away restores the text. Loss spans cover
the escaped texts of assistant turns, in characters and in bytes.

Distribution: places and offsets are running sums in a window by record, then
one aggregate puts a record together. Records that share an id stay apart. A formatted record is one string, so one
task holds one record, as any digest of it must.

Nulls: a null role or text is empty; a null place stands first; ties of places
stand by role and text, and repeated rows are turns each. Records of null id
are one record in rows by turn. Unmatched, empty or malformed records have no
turns and a null mapping. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of roles in other layouts; fixed values.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """turns: (role, path) of single fields, in order; or a list at `each` with the paths of role and text in it."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = field(default=())

    def paths(self) -> list[str]:
        return [f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"] if self.each else [p for _, p in self.turns]


MAPPINGS = (
    Mapping("rows by turn", each="", role="role", text="text", turns=(("", "role"), ("", "text"), ("", "turn"))),
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("message texts", each="messages", role="role", text="text"),
    Mapping("conversations", each="conversations", role="from", text="value"),
    Mapping("turns", each="turns", role="role", text="text"),
    Mapping("dialogue", each="dialogue", role="speaker", text="utterance"),
    Mapping("prompt and completion", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt and response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("question and answer", turns=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("nested data", turns=(("user", "data.prompt"), ("assistant", "data.response"))),
)
KNOWN = sorted({p for m in MAPPINGS for p in m.paths()})


def fingerprint(paths) -> int:
    """XXH64 (seed 42) of the sorted paths, a line each, signed: what xxhash64 gives for the same string in SQL."""
    found = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42)
    return found - (1 << 64) if found >> 63 else found


def prints_of(m: Mapping) -> list[int]:
    """Fingerprints of a mapping's records, one for each choice of optional fields."""
    left_out = [set(c) for n in range(len(m.optional) + 1) for c in combinations(m.optional, n)]
    return [fingerprint(p for p in m.paths() if p not in out) for out in left_out]


def selected(paths: set[str]) -> Mapping | None:
    """The first mapping that has a fingerprint of those of the paths that it knows."""
    return next((m for m in MAPPINGS if fingerprint(paths & set(m.paths())) in prints_of(m)), None)


def schema_paths(schema: T.StructType, above: str = "") -> set[str]:
    out = set()
    for f in schema.fields:
        kind, path = f.dataType, above + f.name
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out |= schema_paths(kind.elementType, f"{path}[].")
        elif isinstance(kind, T.StructType):
            out |= schema_paths(kind, f"{path}.")
        else:
            out.add(path)
    return out


def _canonical_role(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(role)), role, F.lit(""))


def turns_of_table(df: DataFrame, id_col: str) -> DataFrame:
    """(id, record, mapping, fingerprint, place, role, text, real) of a table whose columns are the layout."""
    paths = schema_paths(df.schema)
    found = selected(paths)
    if found is None:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    marks = [F.lit(found.name).alias("mapping"), F.lit(fingerprint(paths & set(KNOWN))).alias("fingerprint")]
    if found.name == "rows by turn":
        place = F.row_number().over(Window.partitionBy(id_col).orderBy("turn", "role", "text")).cast("long")
        plain = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
        return df.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("record"), *marks, place.alias("place"), plain("role"), plain("text"), F.lit(True).alias("real"))
    if found.each:
        turns = F.transform(found.each, _role_and_text(found))
    else:
        given = F.array(*[F.struct(F.lit(role).alias("role"), F.col(path).cast("string").alias("text")) for role, path in found.turns if path in paths])
        turns = F.filter(given, lambda t: t["text"].isNotNull())
    return _turns(df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("record"), *marks, turns.cast(TURNS).alias("turns")))


TURNS = "array<struct<role:string,text:string>>"


def _turns(records: DataFrame) -> DataFrame:
    rows = records.select("id", "record", "mapping", "fingerprint", F.posexplode_outer("turns").alias("place", "turn"))
    return rows.select("id", "record", "mapping", "fingerprint", F.col("place").cast("long").alias("place"), _canonical_role(F.col("turn.role")).alias("role"), F.coalesce("turn.text", F.lit("")).alias("text"), F.col("turn").isNotNull().alias("real"))


def _role_and_text(m: Mapping):
    return lambda x: F.struct(x[m.role].alias("role"), x[m.text].alias("text"))


def json_paths(json: Column) -> Column:
    """Nested field paths of a JSON record, sorted: keys at the top, keys below an object, keys of any element of a list."""
    below = sorted({p.split("[].")[0] for p in KNOWN if "[]." in p}), sorted({p.split(".")[0] for p in KNOWN if "." in p and "[]." not in p})
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    under = lambda name, found: F.transform(found, lambda k: F.concat(F.lit(name), k))
    part = lambda f, kind: F.from_json(F.get_json_object(json, f"$.{f}"), kind)
    elements = lambda f: F.coalesce(part(f, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    lists = [under(f"{f}[].", F.flatten(F.transform(elements(f), keys))) for f in below[0]]
    objects = [under(f"{f}.", keys(part(f, "map<string,string>"))) for f in below[1]]
    top = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(top, *lists, *objects)))


def turns_of_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, record, mapping, fingerprint, place, role, text, real) of records that are JSON texts, each by its own fingerprints."""
    own = F.monotonically_increasing_id()
    rows = df.select(F.col(id_col).alias("id"), own.alias("record"), F.try_parse_json(json_col).alias("v"), json_paths(F.col(json_col).cast("string")).alias("paths"))
    hashed = lambda paths: F.xxhash64(F.array_join(paths, "\n"))
    rows = rows.withColumn("fingerprint", hashed(F.array_intersect("paths", F.lit(KNOWN))))
    turns, names = F.lit(None), F.lit(None)
    for m in reversed([m for m in MAPPINGS if m.name != "rows by turn"]):
        if m.each:
            listed = F.try_variant_get("v", f"$.{m.each}", f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
            made = F.transform(listed, _role_and_text(m))
        else:
            given = F.array(*[F.struct(F.lit(role).alias("role"), F.try_variant_get("v", f"$.{path}", "string").alias("text")) for role, path in m.turns])
            made = F.filter(given, lambda x: x["text"].isNotNull())
        here = hashed(F.array_intersect("paths", F.lit(m.paths()))).isin(prints_of(m))
        turns = F.when(here, made.cast(TURNS)).otherwise(turns)
        names = F.when(here, F.lit(m.name)).otherwise(names)
    return _turns(rows.select("id", "record", names.cast("string").alias("mapping"), "fingerprint", turns.cast(TURNS).alias("turns")))


START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _header(role: Column) -> Column:
    """A role on one line: backslashes doubled, line breaks as \\n, control strings escaped."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_of(header: Column) -> Column:
    """The role again: between doubled backslashes, which are one each, every \\n is a line break."""
    parts = F.split(unescaped(header), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(id, record, mapping, fingerprint, formatted, loss_spans): one row a record."""
    one = ["id", "record"]
    before = Window.partitionBy(*one).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), _header(F.col("role")), F.lit("\n"))
    rows = turns.select(*one, "mapping", "fingerprint", "place", "role", "real", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.when(F.col("real"), F.concat("head", "body", F.lit(END + "\n"))).otherwise(F.lit("")))
    offset = lambda size: F.coalesce(F.sum(size("piece")).over(before), F.lit(0)).cast("long") + size("head")
    rows = rows.select("*", offset(F.length).alias("from"), offset(F.octet_length).alias("from_byte"))
    span = F.struct("from", (F.col("from") + F.length("body")).alias("to"), "from_byte", (F.col("from_byte") + F.octet_length("body")).alias("to_byte"))
    rows = rows.select(*one, "mapping", "fingerprint", "place", "piece", F.when((F.col("role") == learn) & F.col("real"), span).alias("span"))
    pieces = F.sort_array(F.collect_list(F.struct("place", "piece")))
    grouped = rows.groupBy(*one).agg(F.first("mapping").alias("mapping"), F.first("fingerprint").alias("fingerprint"), pieces.alias("pieces"), F.sort_array(F.collect_list("span")).alias("loss_spans"))
    return grouped.select(*one, "mapping", "fingerprint", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")


def read_back(found: DataFrame) -> DataFrame:
    """(id, record, mapping, formatted, turns, loss): turns and the text under the loss spans, from the formatted strings alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece):
        body = F.substring(piece, len(START) + 1, 2**31 - 1)
        header = F.substring_index(body, "\n", 1)
        return F.struct(_role_of(header).alias("role"), unescaped(F.call_function("substring", body, F.length(header) + 2, F.lit(2**31 - 1))).alias("text"))

    raw = F.col("formatted").cast("binary")
    loss = F.transform("loss_spans", lambda s: F.call_function("substring", raw, (s["from_byte"] + 1).cast("int"), (s["to_byte"] - s["from_byte"]).cast("int")).cast("string"))
    return found.select("id", "record", "mapping", "formatted", F.transform(pieces, turn).alias("turns"), F.transform(loss, unescaped).alias("loss"))


def digest(found: DataFrame, id_name: str = "conv_id") -> DataFrame:
    read = read_back(found)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(F.col("id").alias(id_name), F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
