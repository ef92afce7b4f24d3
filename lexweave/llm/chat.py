r"""Conversations as one text for training with a loss mask, in DataFrame functions only.

Turns are collected as structs and sorted; array functions merge neighbours of the same role to one block, whose
texts are joined by a turn mark; blocks are framed by the marks of their role and concatenated. The mask is a list of byte
spans of the formatted text, one for each assistant text, marks excluded.

    <s>[SYS]...[/SYS][INST]first[TURN]second[/INST][ANS]answer</s>[ROLE]tool[BODY]...[/ROLE]

Texts and roles are escaped so that no mark can occur within them: whatever looks like a mark, with any
number of backslashes after its first character, gets one more, which reading takes away again. A mark's
first character occurs nowhere else in marks, so none can arise where a text and a mark meet.

Defined results: turns are ordered by turn, null first, ties by role and text; a null role or text is empty.
Repeated rows are turns of their own. Rows of a null conversation form one conversation. An empty table gives
an empty table. Other columns are not read. A formatted conversation is one value, as a Spark string below 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template: the marks that open and close a block of a role.
FRAMES = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
START, TURN, ROLE, BODY, END = "<s>", "[TURN]", "[ROLE]", "[BODY]", "[/ROLE]"
LOOKS_LIKE_MARK = r"([\[<])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|ANS\]|TURN\]|BODY\])"
BLOCKS = r"(?s)(?:\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|\[ANS\].*?</s>|\[ROLE\].*?\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, LOOKS_LIKE_MARK, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, LOOKS_LIKE_MARK.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _by_role(role: Column, k: int, other: Column) -> Column:
    out = other
    for name, frame in FRAMES.items():
        out = F.when(role == name, F.lit(frame[k])).otherwise(out)
    return out


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, and mask: byte spans (start, size) of the assistant texts in `formatted`."""
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sides = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    opened = ~F.lag("role").over(sides).eqNullSafe(F.col("role"))
    closed = ~F.lead("role").over(sides).eqNullSafe(F.col("role"))
    rows = rows.withColumns({"opened": opened, "closed": closed, "place": F.row_number().over(sides), "body": escape(F.col("text"))})
    before = F.when(F.col("opened"), _by_role(F.col("role"), 0, F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(BODY)))).otherwise(F.lit(TURN))
    after = F.when(F.col("closed"), _by_role(F.col("role"), 1, F.lit(END))).otherwise(F.lit(""))
    rows = rows.withColumns({"before": before, "after": after})
    sizes = {k: F.octet_length(k).cast("bigint") for k in ("before", "body", "after")}
    ended = F.sum(sizes["before"] + sizes["body"] + sizes["after"]).over(sides.rowsBetween(Window.unboundedPreceding, 0))
    begins = F.lit(len(START)) + ended - sizes["after"] - sizes["body"]
    span = F.when(F.col("role") == "assistant", F.struct(begins.alias("start"), sizes["body"].alias("size")))
    rows = rows.withColumn("span", span)

    turns = F.sort_array(F.collect_list(F.struct("place", "opened", "before", "body", "after", "span")))
    chats = rows.groupBy("conv_id").agg(turns.alias("turns"))
    mask = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return chats.select("conv_id", F.concat(F.lit(START), F.array_join(_blocks(F.col("turns")), "")).alias("formatted"), mask.alias("mask"))


def _blocks(turns: Column) -> Column:
    """Sorted turns merged to one framed text for each run of one role."""
    begins = F.transform(F.filter(turns, lambda t: t["opened"]), lambda t: t["place"])
    ends = F.array_append(F.slice(begins, 2, F.size(begins)), F.size(turns) + 1)
    runs = F.zip_with(begins, ends, lambda begin, end: F.slice(turns, begin, end - begin))
    return F.transform(runs, lambda run: F.concat(F.get(run, 0)["before"], F.array_join(F.transform(run, lambda t: t["body"]), TURN), F.element_at(run, -1)["after"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    marks = {name: (F.length(F.lit(a)), F.length(F.lit(z))) for name, (a, z) in FRAMES.items()}

    def turns_of(block: Column) -> Column:
        other = block.startswith(ROLE)
        role = F.when(other, unescape(F.substring_index(F.substr(block, F.lit(len(ROLE) + 1)), BODY, 1)))
        begin, end = F.when(other, F.instr(block, BODY) + len(BODY)), F.when(other, F.lit(len(END)))
        for name, (frame, (a, z)) in zip(marks, zip(FRAMES.values(), marks.values())):
            mine = block.startswith(frame[0])
            role, begin, end = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, a + 1).otherwise(begin), F.when(mine, z).otherwise(end)
        body = F.substr(block, begin, F.length(block) - end - begin + 1)
        texts = F.transform(F.split(body, r"\[TURN\]"), unescape)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), t.alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(BLOCKS), F.lit(0)), turns_of))


def read_masked(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, in order; the bytes of the whole text are bound once."""
    texts = F.transform(F.array(formatted.cast("binary")), lambda whole: F.transform(mask, lambda s: unescape(F.substring(whole, (s["start"] + 1).cast("int"), s["size"].cast("int")).cast("string"))))
    return texts[0]


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation what format_chats() has written, read back: numbers, and digests of turns and of masked text."""
    read = chats.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), F.array_join(read_masked(F.col("formatted"), F.col("mask")), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
