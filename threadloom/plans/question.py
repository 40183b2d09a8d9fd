"""What a question must be before it is answered."""

from __future__ import annotations

import re

#: Characters of a question at most.
LONGEST = 1_000
# Shapes of known prompt attacks and encoded payloads.
HOSTILE = (
    r"(?i)ignore\s+(?:(?:all|previous|prior|above|my|the|your|these)\s+)*(instructions?|prompts?|rules?)",
    r"(?i)disregard\s+(?:(?:all|your|previous|prior|above|the|my|these)\s+)*(instructions?|prompts?|rules?)",
    r"(?i)forget\s+(everything|all|your)",
    r"(?i)do\s+not\s+follow\s+(your|the|any)",
    r"(?i)override\s+(your|the|all|any)\s+(instructions?|prompts?|rules?)",
    r"(?i)you\s+are\s+now\b",
    r"(?i)\bact\s+as\s+(?:(?:a|an)\s+)?(database|system|admin|root|super|helpful|unrestricted|unfiltered)\b",
    r"(?i)\bsystem\s+prompt\b",
    r"(?i)\bjailbreak\b",
    r"(?i)\b(?:you\s+are\s+DAN|enable\s+DAN|DAN\s+mode)\b",
    r"```",
    r"(?i)\[INST\]",
    r"(?i)<<SYS>>",
    r"(?i)\b(?:base64|hex)\s+decode\s+(?:this|the|it)(?:\s+(?:string|payload|text|code))?\b",
    r"(?i)\bdecode\s+(this|the|it)\s+(string|payload|text|base64|hex|code)\b",
    r"(?i)\b0x[0-9a-f]{8,}\b",
)
# A slot that a question leaves open, and what right behind it fills the slot.
OPEN_SLOT = r"(?i)\b(?:a|an)\s+(?:specific|particular|given|named)\s+([a-z][a-z0-9_-]*)\b"
FILLED = r"(?i)^\s+(?:called|named|with\s+(?:the\s+)?(?:name|id|key|value))\s+[\"']?[a-z0-9]|^\s*[:,]\s*[\"']?[a-z0-9]|^\s*[\"'][a-z0-9]"


class QuestionError(ValueError):
    """A question that is not answered. The message does not tell which shape it met."""


def check_question(question: str, strict: bool = True) -> None:
    """Refuse blank and overlong questions, and with ``strict`` those with a hostile shape."""
    if not question.strip():
        raise QuestionError("the question is empty")
    if len(question) > LONGEST:
        raise QuestionError(f"the question has more than {LONGEST} characters")
    if strict and any(re.search(p, question) for p in HOSTILE):
        raise QuestionError("this question is not answered; ordinary questions may be asked with strict input off")


def missing_referent(question: str) -> str | None:
    """The slot that a question leaves open, such as ``project`` in "a specific project"; None if it names its value."""
    m = re.search(OPEN_SLOT, question)
    return None if m is None or re.search(FILLED, question[m.end() :]) else m.group(1).lower()
