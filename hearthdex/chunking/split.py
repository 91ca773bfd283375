"""Cutting chunks down to a number of bytes without losing any."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Chunk:
    text: str
    start_line: int
    end_line: int
    language: str
    symbol: str | None = None


def text_lines(text: str) -> list[str]:
    """Lines without their ends: split at the line feed, one carriage return less, no phantom last line."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def kept_lines(text: str) -> list[str]:
    """Lines with their line feeds; together they are the text."""
    parts = text.split("\n")
    out = [p + "\n" for p in parts[:-1]]
    return out + [parts[-1]] if parts[-1] else out


def cut_line(line: str, most: int) -> list[str]:
    """Runs of whole characters of at most ``most`` bytes; a wider character stands alone."""
    raw, out, start = line.encode("utf-8", "surrogatepass"), [], 0
    while start < len(raw):
        end = min(start + max(most, 1), len(raw))
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end == start:
            end = start + 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
        out.append(raw[start:end].decode("utf-8", "surrogatepass"))
        start = end
    return out


def split_chunk(chunk: Chunk, most: int) -> list[Chunk]:
    """The chunk, or pieces of at most ``most`` bytes along its lines; a longer line is cut within."""
    if len(chunk.text.encode("utf-8", "surrogatepass")) <= most:
        return [chunk]
    out: list[Chunk] = []
    held, held_bytes, first = [], 0, chunk.start_line

    def flush(next_line: int) -> None:
        nonlocal held, held_bytes
        if held:
            out.append(replace(chunk, text="".join(held), start_line=first, end_line=max(next_line - 1, first)))
        held, held_bytes = [], 0

    number = chunk.start_line
    for line in kept_lines(chunk.text):
        size = len(line.encode("utf-8", "surrogatepass"))
        if held and held_bytes + size > most:
            flush(number)
        if not held:
            first = number
        if size > most:
            flush(number)
            out += [replace(chunk, text=part, start_line=number, end_line=number) for part in cut_line(line, most)]
        else:
            held.append(line)
            held_bytes += size
        number += 1
    flush(number)
    return out


def split_for_embedding(chunks: list[Chunk], most: int) -> list[Chunk]:
    return [piece for c in chunks for piece in split_chunk(c, most)]
