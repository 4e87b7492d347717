"""What a run says: banners, summary lines, the log of problems."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from arcweft.plans.rulebooks import Rulebook, plural

#: The built-in checks that count as rules; styles of the terminal; line between parts of a log.
BUILT_IN, DIVIDER, BETWEEN = 2, "---------", "\n---------\n\n"
STYLES = {"Plain": "", "Title": "\x1b[1;34m", "Success": "\x1b[32m", "Warning": "\x1b[1;33m", "Change": "\x1b[1;36m", "Error": "\x1b[31m"}


@dataclass(frozen=True)
class Run:
    """What a command did: its name, how many modules and rules it went through, and what it found."""

    command: str
    modules: int
    rules: int
    total: int = 0
    auto_fixable: int = 0
    unreadable: tuple[str, ...] = ()  # files that are no text and so no modules

    @property
    def clean(self) -> bool:
        return self.command != "check" or not self.total


def elapsed(seconds: float) -> str:
    return f"{int(seconds * 1000)}ms" if seconds < 1 else f"{seconds:.2f}s"


def summary(run: Run, seconds: float) -> str:
    done = {"check": "Checked", "baseline": "Baselined", "fix": "Scanned"}[run.command]
    rules = "" if run.command == "fix" else f" enforcing {plural(run.rules, 'rule')}"
    return f"⏱  {done} {plural(run.modules, 'module')}{rules} in {elapsed(seconds)}"


def found(run: Run, tool: str) -> str:
    """What to do about problems."""
    some = f"{run.auto_fixable} of them auto-fixable." if run.auto_fixable else "none auto-fixable."
    lines = [f"Found {plural(run.total, 'problem')}, {some}"]
    if run.auto_fixable:
        lines.append(f"   Run `{tool} fix` to fix the {plural(run.auto_fixable, 'auto-fixable problem')}.")
    return "\n".join([*lines, f"   Run `{tool} baseline` to silence all {plural(run.total, 'problem')}."])


def rule_count(rulebooks: list[Rulebook]) -> int:
    return sum(len(b.rules) for b in rulebooks) + BUILT_IN


def banner(rulebooks: list[Rulebook], tool: str) -> list[tuple[str, str]]:
    """(style, text): what rules were loaded, and a warning if there are none."""
    out, total = [], rule_count(rulebooks) - BUILT_IN
    if rulebooks:
        out.append(("Plain", f"📚 Loaded {plural(len(rulebooks), 'rulebook')}, {plural(total, 'rule')}"))
    if not total:
        out.append(("Warning", f"WARNING: No architecture rules loaded. Only the built-in checks run.\nDefine your own rules in {tool}/rules/*.yaml"))
    return out


def fixed(n: int) -> str:
    return f"✨ Fixed {plural(n, 'problem')}!" if n else "✨ The project is already clean!"


def say(style: str, text: str, transcript: bool = False) -> None:
    """To the terminal in its style, errors to stderr; as a transcript, to stdout with the style's name in front."""
    if transcript:
        print(f"[{style}] {text}")
    elif style == "Plain":
        print(text)
    else:
        print(f"{STYLES[style]}{text}\x1b[0m", file=sys.stderr if style == "Error" else sys.stdout)
