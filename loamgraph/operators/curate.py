"""Claims about the graph from an injected text generator, checked before they may load."""

import json
import re
from collections.abc import Callable

#: Words of advice or judgement that a claim must not hold.
_ADVICE = ["should", "must", "ought", "need to", "needs to", "refactor", "refactored", "refactoring", "recommend", "recommended", "recommendation", "extract the", "violation", "antipattern", "anti-pattern", "code smell", "smell", "smells", "smelly", "poorly", "badly", "too many", "excessive", "bloated", "improve", "fix", "worse", "better to"]
_VERDICT = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in _ADVICE) + r")(?!\w)", re.I)


class Refused(ValueError):
    """The answer may not load; the text says why."""


def prompt_for(request: dict) -> str:
    facts = "\n".join(f"- {f}" for f in request.get("facts", []))
    refs = "\n".join(f"- {r}" for r in request["allowed_refs"])
    return f"Subject: {request['target_id']}\nFacts:\n{facts}\nReferences that may be named:\n{refs}\nAnswer with a JSON object of the keys claims (text, source_refs), gap and confidence."


def produce(request: dict, generate: Callable[[str], str]) -> dict:
    """A summary payload without judgement of itself.

    request: target_id, allowed_refs, generator, model, source_commit, facts. References outside the allowed ones drop out, then claims without any; an answer
    without a claim, with words of judgement, without a stated gap or with a confidence that is no number from 0 to 1 is refused, as is a request that names its own judge as generator.
    """
    if not request.get("generator") or not request.get("model") or request["generator"] == request.get("judge"):
        raise Refused("generator and model must be named, and the generator must not be the judge")
    try:
        answer = json.loads(generate(prompt_for(request)))
        claims = [(str(c["text"]), [str(r) for r in c.get("source_refs", [])]) for c in answer["claims"]]
    except (ValueError, KeyError, TypeError) as e:
        raise Refused("the answer is not of the asked form") from e
    allowed = set(request["allowed_refs"])
    kept = [{"text": t, "source_refs": sorted(allowed.intersection(r))} for t, r in claims if allowed.intersection(r)]
    if not kept:
        raise Refused("no claim refers to an allowed reference")
    if any(_VERDICT.search(c["text"]) for c in kept):
        raise Refused("a claim judges")
    gap, conf = answer.get("gap"), answer.get("confidence")
    if not isinstance(gap, str) or not gap.strip():
        raise Refused("no gap is stated")
    if isinstance(conf, bool) or not isinstance(conf, (int, float)) or not 0 <= conf <= 1:
        raise Refused("the confidence is no number from 0 to 1")
    return {"target_id": request["target_id"], "claims": kept, "generator": request["generator"], "model": request["model"], "source_commit": request.get("source_commit"), "gap": gap, "confidence": float(conf)}
