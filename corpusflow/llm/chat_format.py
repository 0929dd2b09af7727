"""Chat formatting by schema fingerprint (DataFrame functions only).

Heterogeneous prompt, instruction and message layouts become canonical turn
rows ``(conv_id, turn, role, text)``.  The layout is found from the *nested
field paths* of the input: the known paths among them are sorted, joined and
hashed, and the hash selects one declarative mapping of ``LAYOUTS``.
:func:`canonical_turns` fingerprints a frame's schema, :func:`json_turns`
fingerprints every row of a column of JSON texts, so one column may mix layouts.

:func:`format_turns` renders conversations as ``<|im_start|>role\\ntext<|im_end|>\\n``
per turn together with the spans of each turn; :func:`read_back` inverts it.
Control strings inside texts are escaped reversibly: every ``<``, followed by n
backslashes and ``|``, gets one more backslash, so escaped text never holds
``<|``; a line break inside a role is written ``<|nl|>``.

Defined results: NULL role or text is empty; a NULL conversation id is one
conversation of its own; turns are ordered by (turn, role, text), NULLs first,
repeated rows are kept; a layout with no turns gives no rows; other columns are
ignored, whatever their names; an unknown layout raises (frames) or gives no
turns and a NULL layout (JSON rows).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
NEWLINE_MARK = "<|nl|>"
TURN_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: turn rows, an array of messages, or fields of one row.

    ``fields`` lists (role, columns joined by a blank line); with ``optional`` roles left out when empty.
    """

    rows: tuple[str, ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ("system",)

    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        if self.array:
            return sorted([f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"])
        return sorted(c for _, cols in self.fields for c in cols)


SHARED_ROLES = {"human": "user", "gpt": "assistant"}

LAYOUTS: dict[str, Layout] = {
    "turn_rows": Layout(rows=("conv_id", "turn", "role", "text")),
    "messages": Layout(array="messages", role="role", text="content"),
    "conversations": Layout(array="conversations", role="from", text="value", roles=SHARED_ROLES),
    "preference": Layout(array="chosen", role="role", text="content"),
    "instruction": Layout(fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    "instruction_only": Layout(fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    "prompt_completion": Layout(fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    "prompt_response": Layout(fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    "system_question": Layout(fields=(("system", ("system_prompt",)), ("user", ("question",)),
                                      ("assistant", ("response",)))),
    "question_response": Layout(fields=(("user", ("question",)), ("assistant", ("response",)))),
    "query_answer": Layout(fields=(("user", ("query",)), ("assistant", ("answer",)))),
    "query_response": Layout(fields=(("user", ("query",)), ("assistant", ("response",)))),
}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaf fields, e.g. ``messages[].role``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def digest(paths: list[str]) -> str:
    """Fingerprint of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


KNOWN = sorted({p for m in LAYOUTS.values() for p in m.paths()})
BY_DIGEST = {digest(m.paths()): name for name, m in LAYOUTS.items()}


def layout_of(schema: T.StructType) -> str:
    """Name of the layout of a schema.

    The known paths of the schema are hashed and looked up.  If other columns
    clash with known paths, the largest layout whose paths are all present is
    taken; none, or two of one size, is an error.
    """
    have = set(field_paths(schema))
    found = BY_DIGEST.get(digest([p for p in have if p in KNOWN]))
    if found:
        return found
    fits = sorted(((len(m.paths()), n) for n, m in LAYOUTS.items() if have.issuperset(m.paths())), reverse=True)
    if not fits:
        raise ValueError(f"no chat layout fits the field paths {sorted(have)}")
    if len(fits) > 1 and fits[0][0] == fits[1][0]:
        raise ValueError(f"field paths fit both {fits[0][1]} and {fits[1][1]}")
    return fits[0][1]


def _clean(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _role(c: Column, roles: dict[str, str]) -> Column:
    out = _clean(c)
    for theirs, ours in roles.items():
        out = F.when(_clean(c) == theirs, F.lit(ours)).otherwise(out)
    return out


def _from_array(messages: Column, m: Layout) -> Column:
    return F.transform(messages, lambda x: F.struct(_role(x[m.role], m.roles).alias("role"),
                                                    _clean(x[m.text]).alias("text")))


def _from_fields(get, m: Layout) -> Column:
    turns = F.array(*[F.struct(F.lit(role).alias("role"),
                               F.array_join(F.filter(F.array(*[_clean(get(c)) for c in cols]), lambda x: x != ""),
                                            "\n\n").alias("text")) for role, cols in m.fields])
    return F.filter(turns, lambda t: ~t["role"].isin(*m.optional) | (t["text"] != ""))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turn rows (conv_id, turn, role, text) of a frame in any known layout."""
    m = LAYOUTS[layout_of(df.schema)]
    if m.rows:
        key, turn, role, text = (F.col(f"`{c}`") for c in m.rows)
        return df.select(key.alias("conv_id"), turn.cast("bigint").alias("turn"), _clean(role).alias("role"),
                         _clean(text).alias("text"))
    turns = (_from_array(F.col(f"`{m.array}`"), m) if m.array else _from_fields(lambda c: F.col(f"`{c}`"), m))
    return _explode(df.select(F.col(f"`{id_col}`").alias("conv_id"), turns.alias("_turns")))


def _explode(df: DataFrame) -> DataFrame:
    return (df.select("conv_id", F.posexplode("_turns").alias("_pos", "_turn"))
              .select("conv_id", F.col("_pos").cast("bigint").alias("turn"), "_turn.role", "_turn.text"))


def _prefixed(prefix: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(prefix), k))


def json_layout(json_col: str) -> tuple[Column, Column]:
    """(variant, layout name) of a JSON text, by the fingerprint of that row's own field paths.

    The paths of an array are those of all its elements.  As in :func:`layout_of`, if other fields clash
    the largest layout whose paths are all present is taken; none, or two of one size, gives NULL.
    """
    v = F.try_parse_json(F.col(f"`{json_col}`"))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    none = F.array().cast("array<string>")
    parts = [F.coalesce(keys, none)]
    for a in sorted({m.array for m in LAYOUTS.values() if m.array}):
        inner = F.transform(F.try_variant_get(v, f"$.{a}", "array<variant>"),
                            lambda x: F.coalesce(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")), none))
        parts.append(F.coalesce(_prefixed(f"{a}[].", F.flatten(inner)), none))
    paths = F.array_sort(F.array_intersect(F.concat(*parts), F.array(*[F.lit(p) for p in KNOWN])))
    mark = F.sha2(F.array_join(paths, "\n"), 256)
    names = F.create_map(*[x for d, n in BY_DIGEST.items() if not LAYOUTS[n].rows for x in (F.lit(d), F.lit(n))])
    fits, sizes = F.lit(None).cast("string"), sorted({len(m.paths()) for m in LAYOUTS.values() if not m.rows})
    for size in sizes:
        of_size = F.filter(F.array(*[F.when(F.size(F.array_except(F.array(*[F.lit(p) for p in m.paths()]), paths)) == 0, F.lit(n))
                                     for n, m in LAYOUTS.items() if not m.rows and len(m.paths()) == size]), lambda n: n.isNotNull())
        fits = F.when(F.size(of_size) == 1, of_size[0]).when(F.size(of_size) == 0, fits)
    return v, F.coalesce(F.try_element_at(names, mark), fits)


def json_turns(df: DataFrame, json_col: str, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(turn rows, (id, layout) of every row) of a column of JSON texts in mixed layouts."""
    v, name = json_layout(json_col)
    rows = df.select(F.col(f"`{id_col}`").alias("conv_id"), v.alias("_v"), name.alias("layout"))
    turns = F.lit(None).cast(TURN_TYPE)
    for n, m in LAYOUTS.items():
        if m.rows:
            continue
        if m.array:
            kind = f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
            own = _from_array(F.try_variant_get(F.col("_v"), f"$.{m.array}", kind), m)
        else:
            own = _from_fields(lambda c: F.try_variant_get(F.col("_v"), f"$.{c}", "string"), m)
        turns = F.when(F.col("layout") == n, own).otherwise(turns)
    return _explode(rows.withColumn("_turns", turns)), rows.select("conv_id", "layout")


def escape(c: Column) -> Column:
    """Text without control strings: ``<`` + n backslashes + ``|`` gets a backslash more."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans.

    ``spans`` has for each turn its start, the start and end of its text (code
    points of ``formatted``, end exclusive) and whether the text is under the
    loss mask.  Offsets are a running sum per conversation; the window and the
    grouping share one exchange on the conversation id.
    """
    t = turns.select("conv_id", "turn", _clean(F.col("role")).alias("role"), _clean(F.col("text")).alias("text"))
    t = t.select("conv_id", "turn", "role", "text",
                 F.concat(F.lit(START), F.regexp_replace(escape(F.col("role")), "\n", NEWLINE_MARK),
                          F.lit("\n")).alias("_head"), escape(F.col("text")).alias("_body"))
    t = t.select("conv_id", "turn", "role", "text", F.concat("_head", "_body", F.lit(END + "\n")).alias("_seg"),
                 F.length("_head").cast("bigint").alias("_h"), F.length("_body").cast("bigint").alias("_b"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_at", F.coalesce(F.sum(F.length("_seg").cast("bigint")).over(w), F.lit(0).cast("bigint")))
    span = F.struct(F.col("_at").alias("turn_start"), (F.col("_at") + F.col("_h")).alias("start"),
                    (F.col("_at") + F.col("_h") + F.col("_b")).alias("end"),
                    (F.col("role") == loss_role).alias("loss"), F.col("_seg").alias("seg"))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(span)).alias("_s"))
    return c.select("conv_id", F.array_join(F.transform("_s", lambda s: s["seg"]), "").alias("formatted"),
                    F.transform("_s", lambda s: F.struct(s["turn_start"].alias("turn_start"), s["start"].alias("start"),
                                                         s["end"].alias("end"), s["loss"].alias("loss"))).alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Invert :func:`format_turns`: adds ``turns`` (role, text) and ``loss_texts`` (texts under the mask).

    Turns are parsed from the formatted text alone; masked texts are cut out of
    it by the spans.
    """
    parts = F.split("formatted", START.replace("|", r"\|"), -1)
    # Before the first mark there is nothing.  The length is exact: interpreted, ``slice`` adds it to the start.
    df = formatted.withColumn("_segs", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))

    def turn(s: Column) -> Column:
        cut = F.instr(s, "\n")
        role = F.regexp_replace(F.substring(s, F.lit(1), cut - 1), NEWLINE_MARK.replace("|", r"\|"), "\n")
        body = F.substring(s, cut + 1, F.length(s) - cut - (len(END) + 1))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    under = F.filter(F.zip_with("_segs", "spans", lambda s, p: F.when(p["loss"], unescape(F.substring(
        s, (p["start"] - p["turn_start"] - len(START) + 1).cast("int"), (p["end"] - p["start"]).cast("int"))))),
        lambda x: x.isNotNull())
    return (df.withColumn("turns", F.transform("_segs", turn)).withColumn("loss_texts", under).drop("_segs"))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation: counts and SHA-256 digests of what was read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    r = read.withColumn("_loss", F.array_join("loss_texts", ""))
    return r.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                    F.sha2(whole, 256).alias("turns_sha256"), F.length("_loss").cast("bigint").alias("loss_chars"),
                    F.sha2("_loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("bigint").alias("formatted_chars"))
