"""Code in texts, line by line: an automaton that knows in which kind of block a line stands."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# What opens a block, and how much text before it is its context.
FENCE = re.compile(r"\s*```(\w*)\s*$")
DOCKERFILE = re.compile(r"FROM\s+\S")
SHELL = re.compile(r"\$\s+\S")
DOCKER = re.compile(r".*?(docker\s+(?:run|build|pull|push|exec|compose)\b.*)", re.I)
CONTEXT = {"fenced": 200, "inline": 150}
#: Shorter shell blocks are no examples; blocks with so many equal characters at their start are one.
LEAST_SHELL, SAME_START = 11, 100


class Example(NamedTuple):
    at: int  #: number of the block's first line
    language: str
    format: str
    code: str
    context: str
    line_count: int


def context_before(text: str, n: int) -> str:
    """What the last n characters of the text say, from the last full stop on."""
    tail = text[max(0, len(text) - n) :].strip()
    return tail[tail.rfind(".") + 1 :].strip() if tail.rfind(".") > 0 else tail


def _blocks(lines: list[str]) -> Iterator[tuple[str, str, int, int, int, str]]:
    """(language, format, first line, first line of the code, line after the code, its text) of each block; an open fence
    at the end is none."""
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if m := FENCE.match(line):
            end = next((j for j in range(i + 1, n) if lines[j].lstrip().startswith("```")), None)
            if end is None:
                i += 1
                continue
            yield m[1].lower() or "unknown", "fenced", i, i + 1, end, "\n".join(lines[i + 1 : end])
            i = end + 1
        elif DOCKERFILE.match(line):
            end = next((j for j in range(i + 1, n) if not lines[j].strip() and j + 1 < n and lines[j + 1][:1].isalpha()), n)
            yield "dockerfile", "inline", i, i, end, "\n".join(lines[i:end])
            i = end
        elif SHELL.match(line):
            end = next((j for j in range(i, n) if not SHELL.match(lines[j])), n)
            yield "bash", "inline", i, i, end, "\n".join(lines[i:end])
            i = end
        elif m := DOCKER.match(line):
            end = next((j for j in range(i + 1, n) if not re.match(r"\s+\S", lines[j])), n)
            yield "bash", "inline", i, i, end, "\n".join([m[1], *lines[i + 1 : end]])
            i = end
        else:
            i += 1


def code_examples(text: str | None, language: str = "") -> list[Example]:
    """Fenced blocks, Dockerfiles (from FROM to a blank line before prose), runs of lines after a $, and docker commands with
    the indented lines below, in order of the text, each with what is said before it.

    What stands in a fence belongs to the fence. Of blocks that start alike the first counts. language: only blocks of it.
    """
    lines = (text or "").split("\n")
    ends, size = [], 0
    for line in lines:
        ends.append(size)
        size += len(line) + 1
    out, seen = [], set()
    for lang, kind, first, _, _, code in _blocks(lines):
        code = code.strip()
        if language and lang != language.lower() or lang == "bash" and code.startswith("$") and len(code) < LEAST_SHELL:
            continue
        if code[:SAME_START] not in seen:
            seen.add(code[:SAME_START])
            before = ends[first]
            out.append(Example(first, lang, kind, code, context_before(text[max(0, before - 2 * CONTEXT[kind]) : before][-CONTEXT[kind] :], CONTEXT[kind]), code.count("\n") + 1))
    return out
