"""Texts to time an embedding model with."""

from __future__ import annotations

from itertools import cycle, islice

#: Timed if no file is given.
SAMPLES = (
    "A scan reads the folders once and lists what it may read.",
    "目次から必要な段落だけを読み込む。",
    "Los fragmentos largos se cortan en ventanas que se solapan.",
    "Wer zweimal fragt, bekommt zweimal dieselbe Antwort.",
)


def blocks_of(text: str) -> list[str]:
    """Blocks between blank lines, or the lines of a text that is one block; stripped, without blank ones."""
    found = text.split("\n\n")
    return [b.strip() for b in (found if len(found) > 1 else text.splitlines()) if b.strip()]


def timing_texts(path: str | None, count: int) -> list[str]:
    """``count`` texts of a file, or of ``SAMPLES``, over and over; an empty file or count is an error."""
    if count < 1:
        raise ValueError(f"at least one text is needed, not {count}")
    if path is None:
        found = list(SAMPLES)
    else:
        with open(path, encoding="utf-8") as file:
            found = blocks_of(file.read())
    if not found:
        raise ValueError(f"no text in {path}")
    return list(islice(cycle(found), count))
