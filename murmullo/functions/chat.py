"""Fields of live-chat exports and topic events."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from murmullo.functions.text import clean_lake_text, non_empty, text_or_empty

# Short messages worth keeping, shortest other message, file name form.
KEEP_SHORT = ("jp", "fp", "jne", "onpe", "no", "si", "sí")
MIN_CHARS = 3
VIDEO_FILE_PATTERN = r"\[([A-Za-z0-9_-]{8,})\]\.live_chat\.json$"


def runs_to_text(runs: Column) -> Column:
    """Text of a run list: plain text, else the emoji's first shortcut, else its label."""
    pieces = F.transform(
        runs,
        lambda run: F.coalesce(
            run["text"],
            F.get(run["emoji"]["shortcuts"], F.lit(0)),
            run["emoji"]["image"]["accessibility"]["accessibilityData"]["label"],
            F.lit(""),
        ),
    )
    return clean_lake_text(F.array_join(pieces, ""))


def runs_to_plain_text(runs: Column) -> Column:
    """Concatenated text of the runs; emoji and cleaning left out."""
    return F.coalesce(F.array_join(F.transform(runs, lambda run: run["text"]), ""), F.lit(""))


def badges(author_badges: Column) -> Column:
    """Badge tooltips joined by '|', blanks left out."""
    tooltips = F.transform(author_badges, lambda badge: badge["liveChatAuthorBadgeRenderer"]["tooltip"])
    return F.coalesce(F.array_join(F.filter(tooltips, lambda tip: F.length(tip) > 0), "|"), F.lit(""))


def video_id_from_file(file_name: Column) -> Column:
    return F.regexp_extract(text_or_empty(file_name), VIDEO_FILE_PATTERN, 1)


def is_worth_keeping(message: Column) -> Column:
    """Enough characters without blanks, or one of the short words kept on purpose."""
    compact = F.lower(F.replace(clean_lake_text(message), F.lit(" "), F.lit("")))
    return compact.isin(*KEEP_SHORT) | (F.length(compact) >= MIN_CHARS)


def event_id(source_path: Column, video: Column, usec: Column, channel: Column, author: Column, row: Column) -> Column:
    """First 32 hex digits of the SHA-256 over the '|'-joined identity; null parts are empty."""
    parts = [text_or_empty(c) for c in (source_path, video, usec, channel, author, row)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def event_key(video: Column, usec: Column, channel: Column, author: Column) -> Column:
    """Topic key: the non-empty identity parts joined by '|', null when there are none."""
    return non_empty(F.concat_ws("|", *[non_empty(c) for c in (video, usec, channel, author)]))
