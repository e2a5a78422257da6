"""What the brace languages share: text with strings and comments blanked at equal length, and matching brackets."""

from __future__ import annotations

import bisect
import re


class Source:
    """A text, and ``bare``: the same with the insides of strings and comments as spaces, so that offsets agree."""

    def __init__(self, text: str, pattern: re.Pattern[str]) -> None:
        self.text = text
        blank = lambda m: re.sub(r"[^\n]", " ", m[0])
        self.bare = pattern.sub(blank, text)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.close: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[()\[\]{}]", self.bare):
            c = m[0]
            if c in "([{":
                stack.append((c, m.start()))
            else:
                while stack and stack[-1][0] != pairs[c]:
                    stack.pop()  # an unmatched bracket of another kind is left open
                if stack:
                    self.close[stack.pop()[1]] = m.start()

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def end_of(self, at: int) -> int:
        """Where the bracket at ``at`` closes; the text's end if it doesn't."""
        return self.close.get(at, len(self.text) - 1)

    def between(self, lo: int, hi: int) -> str:
        return self.text[lo:hi]


def split_top(text: str, bare: str, mark: str = ",") -> list[str]:
    """Parts of ``text`` at marks outside of all brackets, trimmed, without empty ones."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(bare):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and bare[i - 1 : i] != "="):
            depth = max(0, depth - 1)
        elif c == mark and not depth:
            out.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]
