"""Rules that keep or drop cues: predicates over columns, and the first rule that drops a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheaf.functions.text import spoken_chars, strip

from .ranges import RANGE_ROWS, by_size, inside

SHORT_REPLIES = ("yes",)
DROP_PATTERNS = ("Thanks for watching",)


def is_short_reply(text: Column, replies: Sequence[str] = SHORT_REPLIES) -> Column:
    return strip(text).isin(*replies)


def is_blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def low_confidence(confidence: Column, text: Column, replies: Sequence[str] = SHORT_REPLIES, least: float = -1.0) -> Column:
    """Missing confidence counts as 0."""
    return (F.coalesce(confidence, F.lit(0.0)) < least) & ~is_short_reply(text, replies)


def is_boilerplate(text: Column, patterns: Sequence[str] = DROP_PATTERNS, replies: Sequence[str] = SHORT_REPLIES) -> Column:
    """A pattern is found anywhere."""
    return strip(text).rlike("|".join(f"(?:{p})" for p in patterns)) & ~is_short_reply(text, replies)


def has_char_run(text: Column, repeats: int = 4, replies: Sequence[str] = SHORT_REPLIES) -> Column:
    """A character stands more than `repeats` times in a row, and the text is longer than 5."""
    return strip(text).rlike(rf"(.)\1{{{repeats},}}") & (F.length(strip(text)) > 5) & ~is_short_reply(text, replies)


def too_slow(text: Column, duration_ms: Column, per_10s: int = 3, over_ms: int = 3000, replies: Sequence[str] = SHORT_REPLIES) -> Column:
    return (spoken_chars(strip(text)) * 10_000 < per_10s * duration_ms) & (duration_ms > over_ms) & ~is_short_reply(text, replies)


def too_fast(text: Column, duration_ms: Column, per_s: int = 20, replies: Sequence[str] = SHORT_REPLIES) -> Column:
    return (duration_ms > 0) & (spoken_chars(strip(text)) * 1000 > per_s * duration_ms) & ~is_short_reply(text, replies)


def too_short(text: Column, duration_ms: Column, least_ms: int = 300, replies: Sequence[str] = SHORT_REPLIES) -> Column:
    return (duration_ms < least_ms) & ~is_short_reply(text, replies)


def too_long(duration_ms: Column, most_ms: int = 30_000) -> Column:
    return duration_ms > most_ms


_NEAR = 5


def _prints(cues: DataFrame) -> DataFrame:
    """Adds `_print`: a hash of the stripped text and one of the whole row; comparing these moves no text."""
    text = F.xxhash64(strip(F.col("text")), F.length("text"))
    return cues.withColumn("_print", F.struct(text.alias("text"), F.xxhash64("start_ms", "end_ms", "text", "confidence", F.col("confidence").isNull()).alias("row")))


def _beside(window: Window) -> tuple[Column, Column]:
    """Whether a twin stands in the last five of the rows from 5 before to 5 after, and whether fewer than five rows follow.

    Five rows on: these decide. Only where fewer follow, rows before count as well, as many as are missing.
    """

    def twin(other: Column) -> Column:
        return (other["text"] == F.col("_print.text")) & (other["row"] != F.col("_print.row"))

    after = [F.lead("_print", k).over(window) for k in range(1, _NEAR + 1)]
    hits = [twin(x) for x in after]
    hits += [after[_NEAR - 1 - k].isNull() & twin(F.lag("_print", k).over(window)) for k in range(1, _NEAR)]
    hit = F.coalesce(hits[0], F.lit(False))
    for h in hits[1:]:
        hit = hit | F.coalesce(h, F.lit(False))
    return hit, after[-1].isNull()


def _spoken(c: DataFrame, replies: Sequence[str]) -> DataFrame:
    return c.withColumn("repeated", F.col("_hit") & ~is_short_reply(F.col("text"), replies)).drop("_hit", "_print")


def repeats_whole(cues: DataFrame, replies: Sequence[str] = SHORT_REPLIES) -> DataFrame:
    """with_repeats with one window a media."""
    return _spoken(_prints(cues).withColumn("_hit", _beside(Window.partitionBy("media_id").orderBy("start_ms", "seq"))[0]), replies)


def repeats_cut(cues: DataFrame, replies: Sequence[str] = SHORT_REPLIES) -> DataFrame:
    """The same over ranges with a halo: only the last five rows of a range look into the next ones, of which the first five rows suffice."""
    w = inside("start_ms", "seq")
    hit, tail = _beside(w)
    c = _prints(cues).withColumns({"_hit": hit, "_tail": tail, "_at": F.row_number().over(w)})
    edges = c.filter(F.col("_tail") | (F.col("_at") <= _NEAR)).withColumn("_hit", _beside(Window.partitionBy("media_id").orderBy("start_ms", "seq"))[0])
    return _spoken(c.filter("NOT _tail").unionByName(edges.filter("_tail")).drop("_tail", "_at"), replies)


def with_repeats(cues: DataFrame, replies: Sequence[str] = SHORT_REPLIES, above: int = RANGE_ROWS) -> DataFrame:
    """Adds `repeated`: the text stands in the last five of the rows from 5 before to 5 after.

    Away from the end these are the next five rows; for the last five rows of a media they are the
    media's last five. A row equal in all its values counts as the row itself; short replies are exempt.
    """
    return by_size(cues, lambda c: repeats_whole(c, replies), lambda c: repeats_cut(c, replies).drop("_range"), above=above)


def drop_reason(patterns: Sequence[str] = DROP_PATTERNS, replies: Sequence[str] = SHORT_REPLIES) -> Column:
    """The first rule that drops a row that with_repeats has marked, null if it is kept."""
    t, d = F.col("text"), F.col("end_ms") - F.col("start_ms")
    return (
        F.when(is_blank(t), "blank")
        .when(low_confidence(F.col("confidence"), t, replies), "confidence")
        .when(is_boilerplate(t, patterns, replies), "pattern")
        .when(has_char_run(t, 4, replies), "run")
        .when(too_slow(t, d, replies=replies), "slow")
        .when(too_fast(t, d, replies=replies), "fast")
        .when(too_short(t, d, replies=replies), "too_short")
        .when(too_long(d), "too_long")
        .when(F.col("repeated"), "repeat")
    )


def with_drop_reason(cues: DataFrame, patterns: Sequence[str] = DROP_PATTERNS, replies: Sequence[str] = SHORT_REPLIES, above: int = RANGE_ROWS) -> DataFrame:
    """Adds `reason`: the first rule that drops the row, null if it is kept."""
    return with_repeats(cues, replies, above).withColumn("reason", drop_reason(patterns, replies)).drop("repeated")


def kept_whole(cues: DataFrame) -> DataFrame:
    """Rows that no rule drops, of media that are one window each."""
    return repeats_whole(cues).filter(drop_reason().isNull()).drop("repeated")


def kept_cut(cues: DataFrame) -> DataFrame:
    """The same of media in ranges."""
    return repeats_cut(cues).filter(drop_reason().isNull()).drop("repeated")


def is_hallucination(text: Column, duration_ms: Column, patterns: Sequence[str] = DROP_PATTERNS) -> Column:
    """Second rule set: a pattern at the start, under 0.5 characters a second over 3 s, over 12 a second, or blank; blanks at the ends count as characters of the rate."""
    t = strip(text)
    n = F.length(text)
    slow = (duration_ms > 3000) & (n * 2000 < duration_ms)
    fast = (duration_ms > 0) & (n * 1000 > 12 * duration_ms)
    return (F.length(t) == 0) | t.rlike("^(?:" + "|".join(patterns) + ")") | slow | fast


def valid_chunk(duration_ms: Column, size_bytes: Column, least_ms: int = 100, least_bytes: int = 1000, planned_ms: Column | None = None, least_planned_ms: int = 1000) -> Column:
    """Long and large enough; where a planned length is given, as for the last chunk of a media, it is a second at least."""
    ok = (duration_ms > least_ms) & (size_bytes > least_bytes)
    return ok if planned_ms is None else ok & (planned_ms >= least_planned_ms)


def near_white(r, g, b, greatest: Callable = F.greatest, least: Callable = F.least):
    """Bright and grey enough; thousandths keep the brightness exact. The channels are columns, or arrays with the functions of arrays."""
    high, low = greatest(greatest(r, g), b), least(least(r, g), b)
    return (299 * r + 587 * g + 114 * b > 150_000) & (high - low < 30) & (low > 160)


def noise_intervals(clips: DataFrame) -> DataFrame:
    """Adds `is_noise` to clips (media_id, part, samples): quiet against the whole media and outright, or crossing zero too often.

    The crossing rate counts 2 for each change of sign, over the number of samples.
    """

    def loud(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v))

    sign = F.transform("samples", lambda v: F.signum(v))
    crossing = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("samples") - 1, F.lit(1))), F.lit(0.0), lambda a, i: a + F.coalesce(F.abs(F.get(sign, i) - F.get(sign, i - 1)), F.lit(0.0)))
    c = clips.withColumns({"_loud": loud(F.col("samples")), "_n": F.size("samples"), "crossing_rate": F.round(crossing / F.size("samples"), 6)})
    whole = Window.partitionBy("media_id")
    mean, all_mean = F.col("_loud") / F.col("_n"), F.sum("_loud").over(whole) / F.sum("_n").over(whole)
    return c.withColumn("is_noise", ((mean < 0.1 * all_mean) & (mean < 0.001)) | (F.col("crossing_rate") > 0.4)).drop("_loud", "_n")
