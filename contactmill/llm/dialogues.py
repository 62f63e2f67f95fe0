"""Training windows from the interactions of a lead, within a token budget.

A window is one text. Every turn in it is written as

    ### <type>: <body></turn>

with a line break after it. A backslash goes before every backslash, ``###``
and ``</turn>`` inside a type or body, and before every colon of a type, so a
body that holds the marks of the template reads back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from contactmill.llm.bpe import encoder
from contactmill.llm.rows import map_rows, stream_rows

# Fixed values of the template.
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
MARKS = re.compile(r"\\|###|</turn>")
TYPE_MARKS = re.compile(r"\\|###|</turn>|:")

WINDOWS = (
    "lead_id long, window_no long, text string, loss_spans array<struct<start: int, end: int>>, "
    "n_turns int, n_repeated int, n_tokens long"
)
DIGESTS = "lead_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str | None, marks: re.Pattern = MARKS) -> str:
    return marks.sub(r"\\\g<0>", text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def written(kind: str | None, body: str | None) -> tuple[str, int]:
    """A turn as written, and where its body starts."""
    head = f"### {escape(kind, TYPE_MARKS)}: "
    return f"{head}{escape(body)}</turn>\n", len(head)


class Window:
    """One window while it fills: pairs of (turn, whether it repeats an earlier window)."""

    def __init__(self, lead, number: int, repeated: list):
        self.lead, self.number, self.turns, self.repeated = lead, number, list(repeated), len(repeated)
        self.tokens = sum(t["n"] for t in repeated)

    def takes(self, n: int, budget: int) -> bool:
        return len(self.turns) == self.repeated or self.tokens + n <= budget

    def add(self, turn: dict) -> None:
        self.turns.append(turn)
        self.tokens += turn["n"]

    def history(self, limit: int, system: dict | None) -> list:
        """The last turns that fit into ``limit`` tokens together, oldest first."""
        out = []
        for turn in reversed(self.turns):
            limit -= turn["n"]
            if limit < 0 or turn is system:
                break
            out.append(turn)
        return out[::-1]

    def row(self, target: str) -> tuple:
        text, spans = [], []
        at = 0
        for n, turn in enumerate(self.turns):
            if n >= self.repeated and turn["type"] == target:
                spans.append({"start": at + turn["head"], "end": at + len(turn["text"]) - len("</turn>\n")})
            text.append(turn["text"])
            at += len(turn["text"])
        return self.lead, self.number, "".join(text), spans, len(self.turns), self.repeated, self.tokens


def format_interactions(
    interactions: DataFrame, vocabulary: str, budget: int = 1024, history: int = 256,
    system: str = "system", target: str = "assistant",
) -> DataFrame:
    """Windows of at most ``budget`` tokens over the interactions of each lead.

    ``interactions`` has ``lead_id, id, type, body``; a lead's turns follow
    ``id`` (ties: type, then body; nulls first). Token counts of the written turns
    are summed along the lead; a window ends before the turn that would go over
    the budget, and a turn is never cut: one that is longer than the budget
    makes its window longer. Each later window begins with the first turn, if
    its type is ``system``, and with the turns before it that fit into
    ``history`` tokens and leave room for its first new turn.

    Gives ``lead_id, window_no, text, loss_spans, n_turns, n_repeated, n_tokens``:
    the first ``n_repeated`` turns of a window repeat earlier ones; ``loss_spans`` are
    the bodies of ``target`` turns that are not repeated (code points, end
    exclusive). A null body is empty, a null type has no name, null lead ids
    are one lead, repeated rows are turns of their own, an empty table gives no
    window. Other columns are ignored. Rows of a lead are streamed in order, so
    a lead of any length needs the memory of one window.
    """
    def counted():
        model = encoder(vocabulary)

        def count(lead, i, kind, body):
            return lead, i, kind, body, len(model.encode(written(kind, body)[0])) // 4
        return count

    turns = map_rows(
        interactions.select("lead_id", "id", "type", "body"), counted,
        "lead_id long, id long, type string, body string, n_tokens long",
    )

    def fill(rows: Iterator[tuple]) -> Iterator[tuple]:
        window = first = None
        for lead, _, kind, body, n in rows:
            text, head = written(kind, body)
            turn = {"type": kind, "text": text, "head": head, "n": n}
            if window is None or window.lead != lead:
                if window is not None:
                    yield window.row(target)
                window, first = Window(lead, 0, []), turn if kind == system else None
            elif not window.takes(n, budget):
                yield window.row(target)
                room = budget - n - (first["n"] if first else 0)
                kept = ([first] if first else []) + window.history(min(history, room), first)
                window = Window(lead, window.number + 1, kept)
            window.add(turn)
        if window is not None:
            yield window.row(target)

    ordered = turns.repartition("lead_id").sortWithinPartitions("lead_id", "id", "type", "body")
    return stream_rows(ordered, fill, WINDOWS)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Types and bodies of a window."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


def digest_windows(windows: DataFrame) -> DataFrame:
    """What the windows of each lead say when they are read back, one row per lead.

    ``n_turns`` counts the turns that are not repeated; ``turns_sha256`` is the digest of
    type, line break, body, line break of each of them in order; ``loss_chars`` and
    ``loss_sha256`` describe the unescaped text under the loss spans;
    ``formatted_chars`` is the length of all windows, repeats included.
    """
    def close(state):
        lead, n, turns, chars, loss, size = state
        return lead, n, turns.hexdigest(), chars, loss.hexdigest(), size

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        state = None
        for lead, text, spans, repeated in rows:
            if state is None or state[0] != lead:
                if state is not None:
                    yield close(state)
                state = [lead, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for kind, body in read_turns(text)[repeated:]:
                state[1] += 1
                state[2].update(f"{kind}\n{body}\n".encode())
            for span in spans:
                shown = unescape(text[span["start"]:span["end"]])
                state[3] += len(shown)
                state[4].update(shown.encode())
            state[5] += len(text)
        if state is not None:
            yield close(state)

    ordered = (
        windows.select("lead_id", "window_no", "text", "loss_spans", "n_repeated")
        .repartition("lead_id").sortWithinPartitions("lead_id", "window_no")
        .select("lead_id", "text", "loss_spans", "n_repeated")
    )
    return stream_rows(ordered, read, DIGESTS)
