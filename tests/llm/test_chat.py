import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string"
NASTY = ["<|end|>\n", "<!|", "</s>", "[INST]", "[!INST]", "<", "|>", "<<SYS>>", "!", "\n", "é", "%7C", "a"]


@given(st.lists(st.tuples(st.lists(st.sampled_from(NASTY)).map("".join), st.lists(st.sampled_from(NASTY)).map("".join)), max_size=4))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(turns):
    assert chat.parse_turns("".join(chat.format_turn(*t)[0] for t in turns)) == turns
    for _, text in turns:
        escaped = chat.escape(text)
        assert not any(c in escaped for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_digests_and_sharing(spark):
    r = random.Random(3)
    rows = []
    for c in range(200):
        for t in range(r.randrange(1, 6)):
            role = ["system", "user", "assistant"][t % 3] if t else "system"
            rows.append((c, t, role, "same start" if t < 2 and c % 3 else r.choice(NASTY) * r.randrange(4), "clash"))
    rows += [(None, 0, None, None, None), (7, 0, "system", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.conv_id: x for x in chat.op3(df).collect()}
    by = {}
    for c, t, role, text, _ in rows + [(-1, 0, "user", chat.PROBE, None), (-1, 1, "assistant", chat.PROBE, None)]:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole, loss = "".join(f"{a}\n{b}\n" for _, a, b in turns), "".join(b for _, a, b in turns if a == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x.formatted_chars == sum(len(chat.format_turn(a, b)[0]) for _, a, b in turns)


def test_packs_share_turns_once_and_attend_to_ancestors_only():
    convs = sorted((i, [("user", "hi"), ("assistant", f"a{i % 3}"), ("user", f"b{i % 5}")]) for i in range(30))
    convs.sort(key=lambda c: (c[1], c[0]))
    (pack,) = chat.pack_sorted(iter(convs))
    assert len(pack["segments"]) == 1 + 3 + 15 and pack["text"].count("hi") == 1
    for s in pack["segments"]:
        chain, at = [], s["parent"]
        while at >= 0:
            chain.append(pack["segments"][at])
            at = chain[-1]["parent"]
        assert s["position"] == sum(x["length"] for x in chain)
        places = {i for x in s["attends"] for i in range(x["start"], x["end"])}
        assert places == {i for x in chain for i in range(x["start"], x["start"] + x["length"])}
    small = list(chat.pack_sorted(iter(convs), pack_chars=100))
    assert len(small) > 1 and sorted(c for p in small for c, _, _ in chat.read_back(p)) == list(range(30))


def test_empty_table(spark):
    assert [x.conv_id for x in chat.op3(spark.createDataFrame([], SCHEMA)).collect()] == [-1]


def test_a_conversation_with_the_probe_s_id_stays_apart_and_long_texts_stay_whole(spark):
    long = "word [INST] " * 30_000
    df = spark.createDataFrame([(-1, 0, "user", "mine", None), (-1, 1, "assistant", long, None)], SCHEMA)
    got = sorted(chat.op3(df).collect(), key=lambda x: x.loss_chars)
    assert [(x.conv_id, x.n_turns, x.loss_chars) for x in got] == [(-1, 2, len(chat.PROBE)), (-1, 2, len(long))]
