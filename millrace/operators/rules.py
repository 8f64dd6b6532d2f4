"""Rewrite rules, compiled into Column expressions that also count their applications.

A rule is a literal or a regular expression for some fields. Rules run one after the other, those
with longer patterns first. A literal rule spares occurrences that overlap a protected word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, functions as F

STATE = "struct<text: string, counts: array<int>>"


@dataclass(frozen=True)
class Rule:
    id: str
    fields: frozenset[str]
    pattern: str
    replacement: str = ""
    reason: str = ""
    literal: bool = True

    @property
    def length(self) -> int:
        return len(re.escape(self.pattern)) if self.literal else len(self.pattern)


def rules_of(document: dict) -> list[Rule]:
    """The enabled rules of a document, longest pattern first, ties in their order."""
    found = [
        Rule(r["id"], frozenset(r["fields"]), r["pattern"], r.get("replacement", ""), r.get("reason", ""), not r.get("regex", False))
        for r in document.get("rules", []) if r.get("enabled", True)
    ]
    return sorted(found, key=lambda r: -r.length)


def document_of(rules: list[Rule]) -> dict:
    return {"version": 1, "rules": [{"id": r.id, "enabled": True, "fields": sorted(r.fields), "regex": not r.literal, "pattern": r.pattern, "replacement": r.replacement, "reason": r.reason} for r in rules]}


def java_pattern(pattern: str) -> str:
    """A pattern in the meaning it has in Python: Unicode classes and cases, \\n as the only line end."""
    flags = "Ud"
    if lead := re.match(r"\(\?([ims]+)\)", pattern):
        pattern = pattern[lead.end() :]
        flags += lead[1] + ("u" if "i" in lead[1] else "")
    return f"(?{flags}){pattern}"


def java_replacement(text: str) -> str:
    """A replacement in Java's notation: group references are $1, other $ and \\ are escaped."""
    out = []
    for part in re.split(r"(\\g<\d+>|\\\d+)", text):
        number = re.fullmatch(r"\\(?:g<)?(\d+)>?", part)
        out.append(f"${number[1]}" if number else part.replace("\\", "\\\\").replace("$", "\\$"))
    return "".join(out)


def _quoted(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#\-&~])", r"\\\1", text)


def guard(fragment: str, words: list[str]) -> str:
    """A pattern for the fragment where it overlaps no occurrence of a word."""
    ahead = set()
    for word in words:
        if fragment not in word:
            continue
        for shift in range(-len(word) + 1, len(fragment)):
            # the word would begin `shift` characters after the fragment does
            both = range(max(0, shift), min(len(fragment), shift + len(word)))
            if any(fragment[i] != word[i - shift] for i in both):
                continue
            before, after = word[: max(0, -shift)], word[max(0, len(fragment) - shift) :]
            inner = fragment if not after else fragment + after
            ahead.add((f"(?<={_quoted(before)})" if before else "") + f"(?={_quoted(inner)})" if before or after else "(?=)")
    return "".join(f"(?!{a})" for a in sorted(ahead)) + _quoted(fragment)


def is_exact(fragment: str, words: list[str]) -> bool:
    """Whether guard() finds just what a scan with non-overlapping words finds."""
    overlaps = lambda w: any(w[:k] == w[-k:] for k in range(1, len(w)))
    return not overlaps(fragment) and not any(fragment in w and overlaps(w) for w in words)


def guarded_replace(text: str, fragment: str, replacement: str, words: list[str]) -> tuple[str, int]:
    """The definition, for the pairs of fragments and words where guard() isn't exact."""
    spans = []
    for word in words:
        at = text.find(word) if fragment in word else -1
        while at >= 0:
            spans.append((at, at + len(word)))
            at = text.find(word, at + len(word))
    out, at, n = [], 0, 0
    while (hit := text.find(fragment, at)) >= 0:
        end = hit + len(fragment)
        spared = any(hit < e and end > s for s, e in spans)
        out += [text[at:hit], fragment if spared else replacement]
        n += not spared
        at = end
    return "".join([*out, text[at:]]), n


def _by_scan(rule: Rule, words: list[str]):
    @F.arrow_udf("array<struct<text: string, n: int>>")
    def scan(items: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("text", pa.string()), ("n", pa.int32())]))
        done = ([dict(zip(("text", "n"), guarded_replace(x, rule.pattern, rule.replacement, words))) for x in row] if row is not None else None for row in items.to_pylist())
        return pa.array(list(done), kind)

    return scan


def _step(pattern: str, into: str):
    def step(s: Column) -> Column:
        return F.struct(F.regexp_replace(s["text"], pattern, into).alias("text"), F.concat(s["counts"], F.array(F.regexp_count(s["text"], F.lit(pattern)))).alias("counts"))

    return step


@dataclass
class Compiled:
    """Rules for one field. apply() takes a list of texts to a list of STATE; counts are in rule order."""

    rules: list[Rule]
    words: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, rules: list[Rule], name: str, words: list[str] | None = None) -> Compiled:
        return cls([r for r in rules if name in r.fields], words or [])

    def apply(self, items: Column) -> Column:
        states = F.transform(items, lambda x: F.struct(x.alias("text"), F.array().cast("array<int>").alias("counts")))
        for rule in self.rules:
            if rule.literal and not is_exact(rule.pattern, self.words) and any(rule.pattern in w for w in self.words):
                scanned = _by_scan(rule, self.words)(F.transform(states, lambda s: s["text"]))
                states = F.zip_with(states, scanned, lambda s, r: F.struct(r["text"].alias("text"), F.concat(s["counts"], F.array(r["n"])).alias("counts")))
                continue
            pattern = guard(rule.pattern, self.words) if rule.literal else java_pattern(rule.pattern)
            into = java_replacement(rule.replacement)
            states = F.transform(states, _step(pattern, into))
        return states

    def changes(self, counts: Column, name: str) -> Column:
        """The changes that counts, a list of numbers in rule order, stand for."""
        if not self.rules:
            return F.array().cast("array<struct<rule: string, field: string, count: int, reason: string>>")
        all_ = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(name).alias("field"), F.element_at(counts, i + 1).alias("count"), F.lit(r.reason).alias("reason")) for i, r in enumerate(self.rules)])
        return F.filter(all_, lambda c: c["count"] > 0)
