import random

from hypothesis import given, settings, strategies as st

from brindle.operators import chunking as c


def docs(spark, *rows):
    return spark.createDataFrame([(p, t, "h") for p, t in rows], "filepath string, content string, content_hash string")


def plain_packing(text, most):
    """The packing of paragraphs as one string that grows."""
    out, cur = [], ""
    for part in text.split("\n\n"):
        if cur and len(cur) + len(part) > most:
            out.append(cur.strip())
            cur = part
        else:
            cur = f"{cur}\n\n{part}" if cur else part
    return out + ([cur.strip()] if cur.strip() else [])


def test_text_packing_equals_the_plain_model(spark):
    r = random.Random(1)
    texts = ["\n\n".join("".join(r.choice("ab \n\x1c\u2003") for _ in range(r.randint(0, 20))) for _ in range(r.randint(0, 12))) for _ in range(200)]
    texts += ["x" * 9 + "\x1c", "\n\n".join(["word "] * 5000) + "\x1c\x85", ""]
    for t in texts:
        assert c.pack_text(t, 25) == plain_packing(t, 25)
    got = c.chunk_text(docs(spark, *[(f"d{k}.txt", t) for k, t in enumerate(texts)]), 25, least=3).collect()
    want = {f"d{k}.txt_chunk_{j}": p for k, t in enumerate(texts) for j, p in enumerate(x for x in plain_packing(t, 25) if len(x) >= 3)}
    assert {r.id: r.text for r in got} == want


def test_ids_noise_and_fences(spark):
    md = "# Title\n\nSome prose here.\n\n```python\nx = 1\n\ny = 2\n```\n\nAfter it."
    got = c.chunk_documents(docs(spark, ("a/x.md", md), ("b/x.md", md), ("n.txt", "Hi\n\nYo"), ("w.txt", " \n\n "), ("e.txt", "")), 200).collect()
    own = sorted((r.id, r.text) for r in got if r.source == "a/x.md")
    assert [t for _, t in own] == ["# Title\n\nSome prose here.", "```python\nx = 1\n\ny = 2\n```", "After it."]
    assert [i for i, _ in own] == ["a/x.md_chunk_0", "a/x.md_chunk_1", "a/x.md_chunk_2"]
    assert {r.source for r in got} == {"a/x.md", "b/x.md", "n.txt"}


def test_markdown_blocks():
    blocks = lambda t: [(b.strip(), f) for b, f in c.markdown_blocks(t)]
    assert blocks("- a\n- b\n\n- c\n\ntext\nmore") == [("- a\n- b\n\n- c", False), ("text\nmore", False)]
    assert blocks("> q\nlazy\n\nTitle\n===\n---\n[x]: http://y\n") == [("> q\nlazy", False), ("Title\n===", False), ("---", False)]
    assert blocks("~~~\na\n```\nb") == [("~~~\na\n```\nb", True)]
    assert blocks("<div>\nx\n\n    code\n\n    more\n") == [("<div>\nx", False), ("code\n\n    more", False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab#`~->\n 1.", max_size=80))
def test_markdown_never_fails_and_loses_no_word(t):
    got = "".join("".join(c.pack_markdown(t, 10)).split())
    assert got == "".join("".join(b for b, _ in c.markdown_blocks(t)).split())
