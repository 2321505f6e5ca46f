import random

import pytest

from lectern.operators import segment

CASES = [
    ("<html><head><title>x</title><body><p>Hi</p>", ["Hi"]),
    ("<p>a</p><button><svg></button><p>b</p>", ["a", "b"]),
    ("<svg><style>x</style></svg>y", ["y"]),
    ("<svg><g><q></svg>after</q><p>more", ["after", "more"]),
    ("<head><script>1</script><meta charset=x><body/><p>t", ["t"]),
    ("<svg><br></svg>one<br>two<hr/>three", ["one", "two", "three"]),
    ("<select><option>a</select>b<svg><title>c</svg>d", ["bd"]),
    ("<object><p>in</p></object>out &amp; <b>bold</b>\n text", ["out & bold text"]),
    ("<head><body>in</body></head>", ["in"]),
    ("<svg>never closed <p>x</p>", []),
    ("", []),
]


@pytest.mark.parametrize("markup,want", CASES)
def test_skipped_elements(spark, markup, want):
    assert spark.createDataFrame([(markup,)], "h string").select(segment.html_paragraphs("h")).first()[0] == want


def by_lists(tags):
    """Skipping told by a list that is searched: the rule without places."""
    out, line, open_ = [], [], []

    def end():
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    for kind, tag in tags:
        if kind == "text":
            if not open_:
                line.append(tag)
        elif kind == "start":
            if tag == "body" and "head" in open_:
                del open_[open_.index("head") :]
            if open_ or tag in segment._Paragraphs.SKIP:
                if tag not in segment._Paragraphs.VOID:
                    open_.append(tag)
            elif tag in segment._Paragraphs.BREAK:
                end()
        elif open_:
            if tag in open_:
                del open_[len(open_) - 1 - open_[::-1].index(tag) :]
        elif tag in segment._Paragraphs.BREAK:
            end()
    end()
    return out


def test_random_nesting():
    rng = random.Random(9)
    for _ in range(3000):
        tags = [(rng.choice(["start", "end", "text"]), rng.choice(["p", "svg", "button", "head", "body", "q", "b", "br", "object"])) for _ in range(rng.randint(1, 25))]
        tags = [(k, f"w{i} " if k == "text" else t) for i, (k, t) in enumerate(tags) if not (k == "end" and t == "br")]
        p = segment._Paragraphs()
        p.feed("".join(t if k == "text" else f"<{t}>" if k == "start" else f"</{t}>" for k, t in tags))
        p.close()
        p.end()
        assert p.out == by_lists(tags), tags
