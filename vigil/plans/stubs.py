"""Deterministic stand-ins for remote services (no network)."""

from __future__ import annotations


def stub_responder(model: str, reasoning: str, prompt: str):
    """Answers from the prompt length; rejects prompts naming one brand."""
    if "Brand#13" in prompt:
        raise RuntimeError("stub responder: request rejected")
    ans = "Yes" if len(prompt) % 2 == 0 else "No"
    text = '{"answer": "%s", "reasoning": "prompt of %d characters"}' % (ans, len(prompt))
    return {"model": model, "reasoning": reasoning, "text": text}, text


def length_scorer(modulus: int):
    """A scorer that depends on the text's length only, so SQL can restate it."""
    return lambda texts: (texts.str.len() % modulus) / float(modulus)
