"""Chat formatting in budgeted windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnish.llm.common import staged, text_of

#: The marks of the template, and marks of other templates that must not come
#: through from a text.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Written after the first character of a control string; itself written as MARK + "0".
MARK = "␛"
#: Tokens of a window, and of the history that it repeats.
BUDGET, HISTORY = 1024, 192
#: Turns that one step of the prefix sums takes, by turn number.
STRETCH = 256


def escape(text: Column) -> Column:
    """The text with every control string broken by a mark; :func:`unescape` undoes it."""
    marked = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}{MARK}1{c[1:]}")), CONTROL, marked)


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + "1"), F.lit("")), F.lit(MARK + "0"), F.lit(MARK))


def turn_tokens(text: Column) -> Column:
    """Words and single punctuation marks, and three for the marks of the turn."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 3


def _prefix_sums(turns: DataFrame, columns: list[str]) -> DataFrame:
    """``before_c`` for every column: its sum over the earlier turns of the conversation.

    Stretches of turn numbers are summed first, so no window holds a whole long conversation.
    """
    inside = Window.partitionBy("conv", "stretch").orderBy("turn", "role", "text_key", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = turns.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"local_{c}") for c in columns])
    sums = turns.groupBy(F.col("conv").alias("o_conv"), F.col("stretch").alias("o_stretch")).agg(*[F.sum(c).alias(c) for c in columns])
    earlier = Window.partitionBy("o_conv").orderBy("o_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("o_conv", "o_stretch", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"offset_{c}") for c in columns])
    on = F.col("conv").eqNullSafe(F.col("o_conv")) & (F.col("stretch") == F.col("o_stretch"))
    sums_before = [(F.col(f"local_{c}") + F.col(f"offset_{c}")).alias(f"before_{c}") for c in columns]
    return local.join(offsets, on).select(*turns.columns, *sums_before)


def _spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """``conv, row, at, tokens, is_system, span`` of every turn; a span is a window's own turns.

    Of the budget a window keeps room for the system turn and the history; the rest is its
    capacity. A turn belongs to the half capacity in which it ends, counted along the prefix sum
    of tokens, and a turn of more than half the capacity stands alone. So the turns of a span
    never exceed the capacity unless a single turn does.
    """
    narrow = turns.select("conv", "turn", "role", "text_key", "row", "tokens", "stretch", F.lit(1).alias("turns"))
    ordered = _prefix_sums(narrow, ["tokens", "turns"])
    is_system = (F.col("before_turns") == 0) & (F.col("role") == "system")
    ordered = ordered.withColumn("is_system", is_system)
    system = ordered.filter("is_system").select(F.col("conv").alias("o_conv"), F.col("tokens").alias("held"))
    sized = ordered.join(system, F.col("conv").eqNullSafe(F.col("o_conv")), "left").select(
        *ordered.columns, F.coalesce("held", F.lit(0)).alias("system")
    )
    half = F.greatest(F.floor((budget - history - F.col("system")) / 2), F.lit(budget // 8))
    sized = sized.withColumn("half", half).withColumn("at", F.col("before_tokens") - F.col("system"))
    sized = sized.withColumn("breaks", F.when(~F.col("is_system") & (F.col("tokens") > F.col("half")), 1).otherwise(0))
    broken = _prefix_sums(sized, ["breaks"])
    span = F.struct(
        F.floor((F.col("at") + F.col("tokens") - 1) / F.col("half")).alias("piece"),
        (2 * F.col("before_breaks") + F.col("breaks")).alias("part"),
    )
    return broken.select("conv", "row", "at", "tokens", "is_system", F.when(~F.col("is_system"), span).alias("span"))


def _members(spans: DataFrame, history: int) -> DataFrame:
    """``conv, span, row, place, repeated``: own turns, repeated history and the system turn."""
    own = spans.filter("span is not null")
    starts = own.groupBy(F.col("conv").alias("n_conv"), F.col("span").alias("n_span")).agg(F.min("at").alias("start"))
    same = F.col("conv").eqNullSafe(F.col("n_conv"))
    # a turn is history of the spans that begin between its end and the reach: one or two cells
    old = own.filter(F.col("tokens") <= history).withColumn("end", F.col("at") + F.col("tokens"))
    cells = F.sequence(F.floor(F.col("end") / history), F.floor((F.col("at") + history) / history)) if history else F.array()
    old = old.select("conv", "row", "at", "end", F.explode(cells.cast("array<long>")).alias("cell"))
    new = starts.withColumn("n_cell", F.floor(F.col("start") / max(1, history)))
    near = (F.col("cell") == F.col("n_cell")) & (F.col("end") <= F.col("start")) & (F.col("at") >= F.col("start") - history)
    repeats = old.join(new, same & near).select("conv", F.col("n_span").alias("span"), "row", "at", F.lit(True).alias("repeated"))
    system = spans.filter("is_system").select("conv", "row", F.lit(-1).cast("long").alias("at"))
    first = F.row_number().over(Window.partitionBy("n_conv").orderBy("n_span")) == 1
    kept = system.join(starts.withColumn("first", first), same, "left")
    # without a span of its own, as in a conversation of a system turn only, it is a window by itself
    kept = kept.select("conv", F.col("n_span").alias("span"), "row", "at", (~F.coalesce("first", F.lit(True))).alias("repeated"))
    fresh = own.select("conv", "span", "row", "at", F.lit(False).alias("repeated"))
    return fresh.unionByName(repeats).unionByName(kept)


def format_chat(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """Windows of conversations: ``conv_id, window, formatted, n_tokens, n_turns, repeated, loss``.

    A turn is written as ``<|role|>``, newline, text, ``<|end|>``, newline; control strings inside
    texts and roles are escaped. Prefix sums of turn tokens cut a conversation into turn-aligned
    spans, each a window of at most ``budget`` tokens unless one turn alone exceeds the room that is
    left. Every window starts with the system turn (a first turn of role ``system``) and repeats
    the turns before it that fit ``history`` tokens whole. ``repeated`` marks, per turn, what an
    earlier window already held. ``loss`` lists the code-point ranges (start, end) of assistant
    texts, repeated ones excepted, so each assistant text is a target exactly once.

    Null text and null role are empty. Turns go by turn number, ties by role, then text; a null
    turn comes first. Rows that agree in all of it are turns of their own. Rows with a null
    conversation form one conversation. An empty table gives an empty result. Other columns are
    not looked at. A turn is never cut, whatever its length.
    """
    text, role = text_of(rows, text_col), text_of(rows, role_col)
    turns = staged(
        rows.select(
            rows[conv_col].alias("conv"),
            rows[turn_col].alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.sha2(text, 256).alias("text_key"),
            turn_tokens(text).cast("long").alias("tokens"),
            F.coalesce(F.floor(rows[turn_col] / STRETCH), F.lit(-(1 << 62))).alias("stretch"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    members = _members(staged(_spans(turns, budget, history)), history)
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    body = escape(F.col("text"))
    written = turns.select("row", "tokens", "role", F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(END)).alias("piece"))
    pieces = members.join(written, "row").groupBy("conv", "span").agg(
        F.sort_array(F.collect_list(F.struct("at", "row", "tokens", "role", "head", "body", "repeated", "piece"))).alias("pieces")
    )
    # where each piece starts: the pieces of a window are bounded by the budget
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + p["head"]
        target = (p["role"] == "assistant") & ~p["repeated"]
        own = F.array(F.struct(start.alias("start"), (start + p["body"]).alias("end")))
        loss = F.when(target, F.concat(state["loss"], own)).otherwise(state["loss"])
        return F.struct((start + p["body"] + len(END)).alias("at"), loss.alias("loss"))

    return pieces.select(
        F.col("conv").alias("conv_id"),
        F.col("span").alias("window"),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("n_tokens"),
        F.size("pieces").alias("n_turns"),
        F.transform("pieces", lambda p: p["repeated"]).alias("repeated"),
        F.aggregate("pieces", zero, step, lambda state: state["loss"]).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the formatted text and the masks alone:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Digests run over a whole conversation, so its parts meet in one row here, as they must.
    """
    parts = F.split("formatted", r"<\|end\|>\n", -1)

    def parsed(part: Column) -> Column:
        head = F.substring_index(part, CLOSE, 1)
        body = F.substring(part, F.length(head) + len(CLOSE) + 1, F.length(part))
        role = F.substring(head, F.lit(len(OPEN) + 1), F.length(head))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), parsed)
    fresh = F.filter(
        F.zip_with(turns, "repeated", lambda t, again: F.struct(t["role"].alias("role"), t["text"].alias("text"), again.alias("again"))),
        lambda t: ~t["again"],
    )
    said = F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    each = windows.select(
        "conv_id", "window", F.size(fresh).alias("n"), said.alias("said"), learned.alias("learned"), F.length("formatted").alias("chars")
    )
    whole = each.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "said", "learned"))).alias("windows"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    joined = {c: F.array_join(F.col("windows")[c], "") for c in ("said", "learned")}
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined["said"], 256).alias("turns_sha256"),
        F.length(joined["learned"]).cast("long").alias("loss_chars"),
        F.sha2(joined["learned"], 256).alias("loss_sha256"),
        "formatted_chars",
    )
