"""Text rules of speech corpora, as column expressions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(text: Column) -> Column:
    """Lower case with sharp s spelled out, as full case folding does."""
    return F.regexp_replace(F.lower(text), "ß", "ss")


def split_words(text: Column) -> Column:
    """Words between white space; a no-break space counts as a space."""
    return F.filter(F.split(F.regexp_replace(text, " ", " "), r"\s+"), lambda w: w != "")


def drop_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{P}", "")


def _plain_words(text: Column) -> Column:
    return split_words(drop_punctuation(F.translate(text, "_<>", " ")))


def _nesting(text: Column) -> Column:
    """How deep matched parentheses are nested: the largest fall of the number of open ones, in one pass over the signs."""
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"), F.lit(0).alias("fall"))

    def step(s: Column, sign: Column) -> Column:
        now = F.when(sign == "(", s["open"] + 1).otherwise(F.greatest(s["open"] - 1, F.lit(0)))
        most = F.greatest(s["most"], now)
        return F.struct(now.alias("open"), most.alias("most"), F.greatest(s["fall"], most - now).alias("fall"))

    return F.aggregate(F.regexp_extract_all(text, F.lit("([()])"), F.lit(1)), start, step, lambda s: s["fall"])


def training_words(surface: Column) -> Column:
    """Words kept for training: parenthesised text goes innermost first, then <>, punctuation, www and xxx.

    Each round takes all innermost parentheses, so there are as many rounds as matched ones are nested.
    """
    depth = _nesting(surface)
    rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    bare = F.aggregate(rounds, surface, lambda s, _: F.regexp_replace(s, r"\([^()]*\)", ""))
    return F.filter(_plain_words(bare), lambda w: ~F.lower(w).isin("www", "xxx"))


def evaluation_words(text: Column) -> Column:
    """Words compared in evaluation: each ( goes with all up to the next ), then <>, punctuation, case."""
    return F.transform(_plain_words(F.regexp_replace(text, r"\([^)]*\)", "")), fold)


def wer_words(text: Column) -> Column:
    """Words of the training-time error rate: case folded, only letters, numbers, underscores and spaces kept."""
    return split_words(F.regexp_replace(fold(F.regexp_replace(text, " ", " ")), r"[^\p{L}\p{N}_\s]", ""))


def label_word(word: Column) -> Column:
    return fold(drop_punctuation(F.trim(word)))


def viewer_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), r"[^\p{L}\p{N}]", "")


def transcript_display(text: Column) -> Column:
    """A transcript line without time marks, [- ...] and [+ ...] notes and @s: tags, with single spaces."""
    out = F.regexp_replace(text, "\x15?\\d+_\\d+\x15?", "")
    # fixed values of the transcript format: notes in brackets, and language tags
    out = F.regexp_replace(out, r"\[[-+].*?\]", "")
    out = F.regexp_replace(out, r"@s:[\w&+]+", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: Fixed values of the transcript format: a speaker's line, and the time mark of an utterance in ms.
SPEECH_LINE = r"^\*([^:]+):\s*(.*)$"
TIME_MARK = "\x15(\\d+)_(\\d+)\x15"


def speech_parts(line: Column) -> dict[str, Column]:
    """speaker, text, start_ms and end_ms (of the first time mark) of a speech line; nulls where absent."""
    speech = F.regexp_extract(line, SPEECH_LINE, 2)

    def number(group: int) -> Column:
        return F.nullif(F.regexp_extract(speech, TIME_MARK, group), F.lit("")).try_cast("long")

    return {"speaker": F.nullif(F.regexp_extract(line, SPEECH_LINE, 1), F.lit("")), "text": speech, "start_ms": number(1), "end_ms": number(2)}


def recording_name(stem: Column) -> Column:
    """Display name: a space between letters and the digits that end them."""
    return F.regexp_replace(stem, r"([A-Za-z]+)_?(\d+)$", "$1 $2")


def file_safe(label: Column) -> Column:
    """A label as part of a file name: everything but letters, digits, dot, dash and underscore becomes a dash."""
    return F.regexp_replace(label, r"[^A-Za-z0-9._-]+", "-")


def resolve_path(path: Column, base: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat_ws("/", F.regexp_replace(base, "/+$", ""), path))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The base name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def recording_key(path: Column) -> Column:
    """The stem without its last _part; the whole stem where there is none."""
    return F.regexp_replace(stem(path), r"_[^_]*$", "")
