"""Column functions on the lines of a pasted text, held as ``array<string>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactmill.functions.limits import shortened
from contactmill import vocab
from contactmill.functions.text import blank_to_null, let, strip

EMPTY = "array<string>"


def no_lines() -> Column:
    return F.array().cast(EMPTY)


def clean_line(c: Column) -> Column:
    """Trimmed, without leading zero-width characters unless nothing else is left."""
    def bare(line: Column) -> Column:
        rest = strip(F.ltrim(line, F.lit(vocab.ZERO_WIDTH)))
        return let(rest, lambda r: F.when(r != "", r).otherwise(line))

    marked = [ch for ch in vocab.ZERO_WIDTH]
    return let(
        strip(c),
        lambda line: F.when(F.substring(line, 1, 1).isin(*marked), bare(line)).otherwise(line),
    )


def split_lines(text: Column) -> Column:
    """Every line, trimmed; blank lines stay as empty strings."""
    return F.transform(F.split(text, vocab.LINE_BREAK), clean_line)


def clean_lines(text: Column) -> Column:
    """The non-blank lines, trimmed.

    Splitting takes the white space around a break with it, so there is no
    per-line trimming; zero-width characters are looked for once per text.
    """
    lines = F.split(strip(text), vocab.BREAK_WITH_MARGIN)
    marked = text.rlike(vocab.ZERO_WIDTH_CLASS)
    return F.when(marked, F.filter(F.transform(lines, clean_line), lambda l: l != "")).otherwise(
        F.when(strip(text) == "", no_lines()).otherwise(lines)
    )


def head(lines: Column, n: int) -> Column:
    return F.slice(lines, F.lit(1), F.lit(n))


def drop(lines: Column, n) -> Column:
    """The lines after the first ``n``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(lines, n + 1, F.greatest(F.size(lines) - n, F.lit(0)))


def line_at(lines: Column, n: int) -> Column:
    return F.try_element_at(lines, F.lit(n))


def first_where(items: Column, keep) -> Column:
    return F.try_element_at(F.filter(items, keep), F.lit(1))


def index_where(items: Column, keep) -> Column:
    """1-based position of the first item that passes, 0 when none does."""
    return F.array_position(F.transform(items, keep), F.lit(True)).cast("int")


def until(items: Column, stop) -> Column:
    """The items before the first one that stops."""
    def cut(at: Column) -> Column:
        return F.when(at > 0, F.slice(items, F.lit(1), at - 1)).otherwise(items)

    return let(index_where(items, stop), cut)


def word_list(words) -> Column:
    """An array literal, built in one step however long the list is."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"array({quoted})")


def is_one_of(c: Column, words) -> Column:
    return F.array_contains(word_list([w.lower() for w in words]), F.lower(c))


def section_after(lines: Column, header: str, stops=()) -> Column:
    """Lines under a section header.

    The header is a whole line, or ``header: first item`` on one line. The
    section ends at a stop header, or at a blank line once it has content.
    """
    low = header.lower()
    ends = (lambda l: (l == "") | is_one_of(l, stops)) if stops else (lambda l: l == "")

    def body_of(title: Column, rest: Column) -> Column:
        same_line = F.when(
            F.lower(title).startswith(low + ":"),
            blank_to_null(clean_line(F.substr(title, F.lit(len(low) + 2)))),
        )
        gap = F.greatest(index_where(rest, lambda l: l != "") - 1, F.lit(0))
        return let(
            same_line,
            lambda first: F.when(
                first.isNotNull(), F.concat(F.array(first), until(rest, ends))
            ).otherwise(let(drop(rest, gap), lambda body: until(body, ends))),
        )

    def found(at: Column) -> Column:
        title = F.try_element_at(lines, F.nullif(at, F.lit(0)))
        return F.when(at > 0, let(drop(lines, at), lambda rest: body_of(title, rest))).otherwise(
            no_lines()
        )

    # The first characters decide: the whole line is the header, or a colon follows it.
    at = index_where(
        lines, lambda l: F.lower(F.substring(l, 1, len(low) + 1)).isin(low, low + ":")
    )
    return F.when(lines.isNotNull(), let(at, found))


def section_text(lines: Column, header: str, stops=(), chars: int | None = None) -> Column:
    joined = F.concat_ws(" ", section_after(lines, header, stops))
    return blank_to_null(shortened(strip(joined), chars))


def list_section(lines: Column, header: str, stops=()) -> Column:
    """Section lines; when empty, the lines after the exact header up to a stop or a link."""
    def loose(at: Column) -> Column:
        rest = let(
            drop(lines, at),
            lambda rest: until(rest, lambda l: is_one_of(l, stops) | l.startswith("http")),
        )
        return F.when(at > 0, rest).otherwise(no_lines())

    return let(
        section_after(lines, header, stops),
        lambda section: F.when(F.size(section) > 0, section).otherwise(
            let(index_where(lines, lambda l: F.lower(l) == header.lower()), loose)
        ),
    )


def split_comma_items(items: Column, stops=()) -> Column:
    """One entry per comma-separated part, up to the first stop word."""
    parts = F.filter(
        F.flatten(F.transform(items, lambda i: F.transform(F.split(i, ","), clean_line))),
        lambda p: p != "",
    )
    if not stops:
        return parts
    return let(parts, lambda all_parts: until(all_parts, lambda p: is_one_of(p, stops)))
