"""Fitted prompts of all conversations against a plain fold."""

import hashlib

from docloom import queries
from docloom.operators import prompt

FOLDER = "/root/testdata/sf0.001"


def tokens(text):
    return len(text) // 4 + 1 if text else 0


def greedy(docs, left):
    kept = []
    for d in docs:
        if tokens(d[2]) <= left:
            left -= tokens(d[2])
            kept.append(d)
    return kept, left


def plain(docs, turns, limit, used):
    """(documents, turns, minimal, error, truncated): documents are (id, url, text, priority), turns (number, role, text), both in order."""
    if used >= limit:
        return [], [], True, False, True
    high, left = greedy([d for d in docs if d[3] == "HIGH"], limit - used)
    error = any(d[3] == "HIGH" for d in docs) and not high
    said = []
    for t in reversed(turns):
        if tokens(t[2]) > left:
            break
        left -= tokens(t[2])
        said.insert(0, t)
    low, _ = greedy([d for d in docs if d[3] == "LOW"], left)
    return sorted(high + low), said, False, error, len(high + low) < len(docs) or len(said) < len(turns)


def test_prompts_of_all_conversations(spark):
    docs = {r.doc_id: (r.doc_id, f"https://docs.example.org/{r.source}/{r.doc_id}.html", r.text, "HIGH" if r.doc_id % 2 == 0 else "LOW") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    turns = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {}
    for i, said in turns.items():
        near = [docs[k] for k in range(i, i + 4) if k in docs]
        if near:
            kept, fitting, minimal, error, truncated = plain(near, sorted(said), 900, 150)
            lines = ["System", *(f"[CTX {n + 1}] {d[1]}\n{d[2]}" for n, d in enumerate(kept)), *(("Assistant: " if t[1] == "assistant" else "") + t[2] for t in fitting), "Query?"]
            text = (prompt.NOTICE if truncated else "") + "\n\n".join(lines)
            shown = " ".join(f"{n + 1}:{d[3]}:{tokens(d[2])}" for n, d in enumerate(kept))
            want[i] = (shown, " ".join(str(t[0]) for t in fitting), minimal, error, truncated, hashlib.sha256(text.encode()).hexdigest())
    found = {r.id: (r.kept, r.turns, r.minimal, r.error, r.truncated, r.prompt_hash) for r in queries.QUERIES["i15_i16_fitted_prompt"](spark, FOLDER).collect()}
    assert found == want and len(want) > 10
