"""Line formats of the supported logs.

A format names its pattern, the layout its groups are rewritten to, and the
typed fields that come out of the layout (see ``operators.parsing``).
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These patterns decide which lines count as well formed and what
# each field holds, so they must stay exactly as they are for equal results.
#   date line      groups: year, month, day, message
#   event line     groups: epoch seconds, user, separator, node, message
#   payload line   groups: epoch seconds, message
#   dated line     groups: epoch seconds, year, month, day, message (the same
#                  lines as the date and the payload line)
#   latency line   groups: second, p50, p999
#   throughput     groups: second, requests, duration in microseconds
#   hardware       groups: second, cpu 1 min, cpu 5 min, total memory, its unit,
#                          free memory, its unit
# ---------------------------------------------------------------------------
DATE_LINE = r"-\s\d+\s(\d+)\.(\d+)\.(\d+)\s\w+\s\w+\s\d+\s\d+:\d+:\d+\s\S+\s(.*)"
EVENT_LINE = r"-\s(\d+)(?:\s\S+){5}\s(\w+)(.)(\w+)\s(.*)"
STRICT_EVENT_LINE = r"-\s(\d+)(?:\s\S+){5}\s(?:(\w+)([^\s\w\x01]))?(\w+)\s(.*)"
PAYLOAD_LINE = r"-\s(\d+)\s\d+\.\d+\.\d+\s\w+\s\w+\s\d+\s\d+:\d+:\d+\s\S+\s(.*)"
DATED_LINE = r"-\s(\d+)\s(\d+)\.(\d+)\.(\d+)\s\w+\s\w+\s\d+\s\d+:\d+:\d+\s\S+\s(.*)"
LATENCY_LINE = r"\[(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\.\d+\].*p50:\s(\d+).*p999:\s(\d+)us.*"
THROUGHPUT_LINE = (
    r"\[(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\.\d{3}\](?:\s\[\w+\])+\s(\d+)\s\w+\s\w+\s(\d+).*"
)
HARDWARE_LINE = (
    r"\[(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2})\.\d+\].*cpu\s1min:\s(\d+.\d+),\scpu\s5min:\s(\d+\.\d+)"
    r".*total\smem:\s(\d+.\d+)\s(\w{2}),.*free\smem:\s(\d+.\d+)\s(\w{2}).*"
)
UNIT_BYTES = {"KB": 2**10, "MB": 2**20, "GB": 2**30}
MATCH_LITERAL = "IRQ"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
FILL_KEY_BYTES = 24
# ---------------------------------------------------------------------------

# (?d): only "\n" ends a line, so a stray carriage return stays inside a field.
_WHOLE = r"(?d)\A{}\z"
_FIND = r"(?d)\A(?s:.*?){}\z"

MARK = "\u0001"


@dataclass(frozen=True)
class LineFormat:
    """A line pattern and the order in which its groups are laid out.

    ``layout`` lists group numbers; a tuple glues groups into one piece. The
    piece that may hold arbitrary text comes last, so a ``MARK`` inside it
    cannot shift another field.
    """

    pattern: str
    layout: tuple
    starts_with: str | None = None

    @property
    def replacement(self) -> str:
        pieces = [p if isinstance(p, tuple) else (p,) for p in self.layout]
        return "".join(MARK + "".join(f"${g}" for g in piece) for piece in pieces)

    @property
    def pieces(self) -> int:
        return len(self.layout) + 1  # the text before the first mark is empty


DATE = LineFormat(_WHOLE.format(DATE_LINE), (1, 2, 3, 4), "-")
EVENT = LineFormat(_WHOLE.format(EVENT_LINE), (1, 2, 4, (3, 5)), "-")
STRICT_EVENT = LineFormat(_WHOLE.format(STRICT_EVENT_LINE), (1, 2, 3, 4, 5), "-")
PAYLOAD = LineFormat(_WHOLE.format(PAYLOAD_LINE), (1, 2), "-")
PAYLOAD_FOUND = LineFormat(_FIND.format(PAYLOAD_LINE), (1, 2))
DATED = LineFormat(_WHOLE.format(DATED_LINE), (1, 2, 3, 4, 5), "-")
LATENCY = LineFormat(_WHOLE.format(LATENCY_LINE), (1, 2, 3), "[")
THROUGHPUT = LineFormat(_WHOLE.format(THROUGHPUT_LINE), (1, 2, 3), "[")
HARDWARE = LineFormat(_WHOLE.format(HARDWARE_LINE), (1, 2, 3, 4, 5, 6, 7), "[")
