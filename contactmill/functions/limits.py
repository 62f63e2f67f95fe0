"""How much of a text the extracted fields keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExtractionLimits:
    """Limits of extracted fields; ``None``, the default of each, keeps or looks at everything.

    ``header_lines`` and ``subject_lines`` are the lines of a mail in which headers and the
    subject are looked for, ``tier_lines`` and ``employer_lines`` the same for a tier line of a directory page
    and the employer of a profile. ``opening_lines`` are the lines that describe a website or a company page. The
    rest are characters: of a mail's summary, a note's description, a page's
    description, a section, and the description in a lead summary.
    """

    header_lines: int | None = None
    subject_lines: int | None = None
    tier_lines: int | None = None
    employer_lines: int | None = None
    opening_lines: int | None = None
    summary_chars: int | None = None
    note_chars: int | None = None
    description_chars: int | None = None
    section_chars: int | None = None
    lead_summary_chars: int | None = None


WHOLE = ExtractionLimits()
#: The lengths of a short card.
SHORT = ExtractionLimits(40, 10, 20, 6, 5, 300, 1000, 500, 2000, 300)


def shortened(text: Column, n: int | None) -> Column:
    return text if n is None else F.substring(text, 1, n)


def first_lines(lines: Column, n: int | None) -> Column:
    return lines if n is None else F.slice(lines, F.lit(1), F.lit(n))
