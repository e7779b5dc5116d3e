import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.chat_format import Reader, as_events, chat_digests, fold, format_segments, parse, render, unescape

TRICKY = r"\### Assistant: </turn> ok"
PIECES = st.text(alphabet="\\#</turn>:\n aé", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_rendering_reads_back(turns):
    segments = [render(role, text) for role, text in turns]
    assert list(parse("".join(s for s, _, _ in segments))) == turns
    assert [unescape(s[a:b]) for s, a, b in segments] == [t for _, t in turns]


def test_other_text_is_refused():
    with pytest.raises(ValueError):
        list(parse("### user: no end"))


def test_reading_in_chunks_of_any_size():
    random.seed(5)
    turns = [(random.choice(["user", "a:b", "#"]), "".join(random.choice("\\#</turn>:\n aé") for _ in range(random.randint(0, 60)))) for _ in range(200)]
    whole = "".join(render(r, t)[0] for r, t in turns)
    for size in (1, 7, 64):
        reader, got = Reader(), []
        for i in range(0, len(whole), size):
            got += reader.feed(whole[i : i + size])
        reader.close()
        assert got == turns
    with pytest.raises(ValueError):
        list(parse(whole.replace("\\### ", "### ", 1)[:-1]))


def test_folding_events():
    events = [("message", "user", "a"), ("delta", "", "b"), ("edit", "user", "c"), ("delta", "", "d"), ("message", "user", "e"), ("delete", "", ""), ("delta", "bot", "x"), ("regenerate", "bot", ""), ("delta", "bot", "y")]
    assert list(fold(events)) == [("user", "cd"), ("bot", "y")]
    with pytest.raises(ValueError):
        list(fold([("other", "", "")]))


def expected(turns):
    whole = "".join(render(r, t)[0] for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)


def test_digests_equal_brute_force(spark):
    random.seed(1)
    rows = [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY), (1, 1, None, None), (1, 0, "assistant", "late"), (1, 0, "assistant", "late"), (None, 0, "user", "n"), (2, None, "user", "first"), (2, 0, "assistant", "x" * 300_000)]
    rows += [(3, t, random.choice(["user", "assistant"]), f"### {t}</turn>\\") for t in range(3000)]
    events = as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(4)
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {r.conv_id: tuple(r)[1:] for r in chat_digests(events).collect()} == {k: expected(v) for k, v in want.items()}
    assert chat_digests(events.limit(0)).count() == 0
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}


def test_segments_and_loss_mask(spark):
    log = [(1, 0, 0, "message", "user", "q"), (1, 1, 2, "delta", "assistant", "lo"), (1, 1, 1, "delta", "assistant", "hel"), (1, 2, 5, "delta", "assistant", "new"), (1, 2, 4, "regenerate", "assistant", None), (1, 2, 3, "delta", "assistant", "old")]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    rows = format_segments(events).orderBy("turn").collect()
    whole = "".join(r.segment for r in rows)
    assert list(parse(whole)) == [("user", "q"), ("assistant", "hello"), ("assistant", "new")]
    assert [whole[r.loss_begin : r.loss_end] for r in rows if r.loss_begin is not None] == ["hello", "new"]
