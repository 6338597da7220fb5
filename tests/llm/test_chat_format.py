import hashlib
import random

import numpy as np
import public_tokenizers

from tessera.llm import chat_format as chat

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_escape_round_trip():
    rng = random.Random(2)
    for _ in range(5000):
        turns = [tuple("".join(rng.choice(["#", "\\", "<", "/turn>", "</turn>", "###", ":", " ", "\n", "h", "t", "é"]) for _ in range(rng.randint(0, 8))) for _ in range(2)) for _ in range(rng.randint(0, 4))]
        text, spans = chat.render(turns, frozenset({"h", ""}))
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r in ("h", "") and t]


def test_intersection_equals_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        cuts = sorted(rng.sample(range(60), 12))
        tokens = np.array([(a, b) for a, b in zip(cuts, cuts[1:])] + [(cuts[-1], cuts[-1] + 2)] * 2)
        edges = sorted(rng.sample(range(62), 8))
        spans = np.array(list(zip(edges[::2], edges[1::2])))
        mask, kept = chat.intersect(tokens, spans)
        assert mask.tolist() == [any(a < e and s < b for s, e in spans) for a, b in tokens]
        inside = {c for a, b in tokens for c in range(a, b)} & {c for s, e in spans for c in range(s, e)}
        assert sorted(c for a, b in kept for c in range(a, b)) == sorted(inside)


def test_frame(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            text = rng.choice([None, "", "hi 😀", "\\### Assistant: </turn> ok", "x" * 3000, " é\n"])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]), text, "extra"))
    rows += [(3, 0, "assistant", "tie", "e")] * 2 + [(None, 1, "user", "a", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(chat.with_probe(df), PATH)).collect()}
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok", ""), (-7, 1, "assistant", "\\### Assistant: </turn> ok", "")]
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        turns = sorted((t, role or "", text or "") for c, t, role, text, _ in rows if c == conv)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0), PATH).count() == 0
