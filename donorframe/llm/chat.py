"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, that reply alone is trainable.
All examples of a conversation are prefixes of one rendered string, so the conversation is rendered once and an example
is a row (or array entry) with the length of its prefix and the span of its loss mask; `examples(..., texts=True)` cuts
the strings out. The output so grows with the input and not with the square of a conversation's turns.

Template: a turn is `<s>[ROLE]role[/ROLE]text</s>`. Inside roles and texts `\\`, `<` and `[` are written `\\e`, `\\l` and
`\\b`: no control string can appear inside a text (all of them begin with `<` or `[`), and unescaping is exact.

Defined cases: a null or empty text is an empty one, a null role the role "" (never trainable); turns are ordered by turn
(nulls first), ties by role and text; repeated rows are turns of their own; rows with a null conv_id form one
conversation; an empty table gives no rows; other columns are ignored. A SHA-256 runs over one string, so one
conversation's turns meet in one row; what is done with them takes time in proportion to their length (times the logarithm
of the turns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, scan

# The template's control strings.
OPEN, ROLE_OPEN, ROLE_CLOSE, CLOSE = "<s>", "[ROLE]", "[/ROLE]", "</s>"
TRAINED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\b"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def render(turns: DataFrame) -> DataFrame:
    """One row per conversation (conv_id, turn, role, text): conv_id, formatted, examples (number of the target turn,
    characters of the example's prefix, start and length of its loss span, in code points of `formatted`)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = turns.select("conv_id", F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN + ROLE_OPEN), escape(F.col("role")), F.lit(ROLE_CLOSE))
    body = escape(F.col("text"))
    rows = slim.select("conv_id", F.struct("turn", "role", "text", head.alias("head"), body.alias("body")).alias("t"))
    by_conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    by_conv = by_conv.select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), F.concat(t.head, t.body, F.lit(CLOSE)).alias("all"), F.length(t.head).alias("head"), F.length(t.body).alias("body"))).alias("turns"))
    ends = scan(F.transform("turns", lambda t: F.length(t["all"]).cast("long")))

    def span(t: Column, i: Column) -> Column:
        start = F.get("ends", i) - F.length(t["all"]) + t["head"]
        return F.when(t["role"] == TRAINED, F.struct(i.alias("turn"), F.get("ends", i).alias("prefix_chars"), start.alias("loss_start"), t["body"].cast("long").alias("loss_chars")))

    formatted = F.array_join(F.transform("turns", lambda t: t["all"]), "")
    return by_conv.withColumn("ends", ends).select("conv_id", formatted.alias("formatted"), F.array_compact(F.transform("turns", span)).alias("examples"))


def replies(formatted: Column, examples: Column) -> Column:
    """What stands under each example's loss mask, unescaped. The control string that ends a turn cuts the formatted text
    into turns, and running sums of their lengths tell where each begins, so a mask is read from its own turn."""

    def told(x: Column) -> Column:
        under = lambda e: F.substr(F.get(x["turns"], e["turn"]), (e["loss_start"] - F.get(x["ends"], e["turn"]) + F.length(F.get(x["turns"], e["turn"])) + len(CLOSE) + 1).cast("int"), e["loss_chars"].cast("int"))
        return F.transform(examples, lambda e: unescape(under(e)))

    return let(F.split(formatted, CLOSE, -1), lambda turns: let(F.struct(turns.alias("turns"), scan(F.transform(turns, lambda t: F.length(t).cast("long") + len(CLOSE))).alias("ends")), told))


def expand(rendered: DataFrame, *more: str) -> DataFrame:
    """One row per assistant turn of render()'s conversations: conv_id, turn, prefix_chars, loss_start, loss_chars, reply
    (what stands under the example's loss mask, unescaped), and more columns. A conversation without such a turn has one
    row of nulls."""
    listed = F.zip_with("examples", replies(F.col("formatted"), F.col("examples")), lambda e, r: F.struct(e["turn"].alias("turn"), e["prefix_chars"].alias("prefix_chars"), e["loss_start"].alias("loss_start"), e["loss_chars"].alias("loss_chars"), r.alias("reply")))
    return rendered.select("conv_id", *more, F.explode_outer(listed).alias("e")).select("conv_id", *more, "e.*")


def examples(turns: DataFrame, texts: bool = False) -> DataFrame:
    """One row per assistant turn: conv_id, turn, prefix_chars, loss_start, loss_chars, reply[, formatted: the context (all
    turns before) and the reply]."""
    rendered = render(turns)
    out = expand(rendered, *(["formatted"] if texts else [])).where("turn is not null")
    if not texts:
        return out
    return out.withColumn("formatted", F.left("formatted", F.col("prefix_chars").cast("int")))


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns (role, text) and trained texts, parsed from the output of render()."""
    # no text holds "<" or "[", so the control strings split the output exactly; the piece after the last one is empty
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    mark = lambda p: F.substring_index(p, ROLE_CLOSE, 1)
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.substr(mark(p), F.lit(len(OPEN + ROLE_OPEN) + 1))).alias("role"), unescape(F.substr(p, F.length(mark(p)) + len(ROLE_CLOSE) + 1)).alias("text")))
    return rendered.withColumn("turns", turns).withColumn("trained", replies(F.col("formatted"), F.col("examples")))


def digest(turns: DataFrame) -> DataFrame:
    """Checksums of what the formatted conversations hold: turns are read back from them, trained texts from the exploded
    examples, each from its own."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    told = ["n_turns", "turns_sha256", "formatted_chars"]
    back = read_back(render(turns)).select("conv_id", "formatted", "examples", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    rows = expand(back, *told).withColumn("target", F.when(F.col("turn").isNotNull(), F.struct("turn", "reply")))
    by_conv = rows.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in told], F.array_sort(F.collect_list("target")).alias("targets"))
    loss = F.array_join(F.transform("targets", lambda t: t["reply"]), "")
    return by_conv.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", F.size("targets").cast("long").alias("n_examples"))
