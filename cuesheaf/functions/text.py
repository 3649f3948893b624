"""Text expressions of cues, file names and page titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forbidden in a file name.
NAME_BREAKS = r'[<>:"/\\|?*]'


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_tags(text: Column) -> Column:
    return strip(F.regexp_replace(text, "<[^>]+>", ""))


def clean_filename(name: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, NAME_BREAKS, "_"), r"(?U)\s+", "_"), 1, most)


def clean_page_title(title: Column, suffix: str = "") -> Column:
    """Without one site suffix and forbidden characters; white space squeezed."""
    cut = F.replace(title, F.lit(suffix), F.lit("")) if suffix else title
    return strip(F.regexp_replace(F.regexp_replace(cut, NAME_BREAKS, " "), r"(?U)\s+", " "))


def safe_media_name(name: Column, most: int = 50) -> Column:
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), 1, most)


def spoken_chars(text: Column) -> Column:
    """Characters without punctuation and white space."""
    return F.length(F.regexp_replace(text, r"(?U)[、。，．,.\s]", ""))


def speech_rate(text: Column, duration_ms: Column) -> Column:
    """Spoken characters a second; 0 for no duration."""
    return F.when(duration_ms > 0, F.round(spoken_chars(text) * 1000 / duration_ms, 6)).otherwise(F.lit(0.0))


def wrap_text(text: Column, width: int) -> Column:
    r"""Cut every `width` characters, the parts joined by a backslash and n."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / width)), lambda i: F.substring(text, (i * width + 1).cast("int"), F.lit(width)))
    return F.array_join(parts, "\\n")


def font_size(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= 20, 16).when(n <= 40, 14).when(n <= 60, 12).otherwise(10)


def format_bilingual(source: Column, target: Column, source_width: int = 20, target_width: int = 25) -> Column:
    """Two font lines, gold source and white target; one white line of the source if there is no target."""
    size = font_size(target)
    small = F.greatest(F.lit(8), size - 2)
    both = F.concat(
        F.lit('<font size="'), small.cast("string"), F.lit('" color="gold">'), wrap_text(source, source_width), F.lit('</font>\n<font size="'),
        size.cast("string"), F.lit('" color="white">'), wrap_text(target, target_width), F.lit("</font>"),
    )
    return F.when(F.coalesce(F.length(target), F.lit(0)) > 0, both).otherwise(F.concat(F.lit('<font size="16" color="white">'), source, F.lit("</font>")))


def is_bilingual(text: Column) -> Column:
    return F.contains(text, F.lit("<font")) & F.contains(text, F.lit("\\n"))
