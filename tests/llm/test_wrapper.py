"""Inference of wrappers: every stream is in the language of its expression, and alignments are the best there are."""

import itertools
import random
import re

from quire.llm import wrapper
from quire.llm.wrapper import Item


def tree(spec):
    """A stream from a nested list: "#" or (name, kids)."""
    return Item("#") if spec == "#" else Item(spec[0], [tree(k) for k in spec[1]])


def written(spec):
    return "#" if spec == "#" else f"{spec[0]}{''.join(map(written, spec[1]))}/{spec[0]}"


def folded(spec):
    """The stream as a page gives it: lists folded from the inside out."""
    if spec == "#":
        return Item("#")
    x = Item(spec[0], [folded(k) for k in spec[1]])
    wrapper.fold(x)
    return x


def random_tree(rng, depth, names):
    if depth == 0 or rng.random() < 0.3:
        return "#"
    return (rng.choice(names), [random_tree(rng, depth - 1, names) for _ in range(rng.choice([0, 1, 1, 2, 3, 5]))])


def test_an_expression_has_all_its_streams():
    rng = random.Random(5)
    for trial in range(150):
        names = ["<div>", "<p>", "<section>", "<h2>"][: rng.randrange(1, 5)]
        specs = [("<>", [random_tree(rng, 3, names) for _ in range(rng.randrange(0, 7))]) for _ in range(rng.randrange(1, 7))]
        out = wrapper.decoded(wrapper.inferred([wrapper.encoded(folded(s)) for s in specs]))
        accepts = re.compile(wrapper.pattern(out))
        for s in specs:
            assert wrapper.covers(out, folded(s)), (trial, s)
            assert accepts.fullmatch(written(s)), (trial, specs, s, wrapper.pattern(out))


def test_long_lists_are_generalised():
    rng = random.Random(1)
    names = [f"<x{k}>" for k in range(9)]
    specs = [("<>", [(rng.choice(names), ["#"]) for _ in range(3000)]) for _ in range(3)]
    out = wrapper.decoded(wrapper.inferred([wrapper.encoded(folded(s)) for s in specs]))
    assert len(out.kids) == 9 and all(re.fullmatch(wrapper.pattern(out), written(s)) for s in specs)


def brute_force(page, wide, loops):
    """Most items of page that any allowed sequence of places takes."""
    best = 0
    for at in itertools.product(range(-1, len(wide)), repeat=len(page)):
        score, before, ok = 0, -1, True
        for i, j in enumerate(at):
            if j < 0:
                continue
            if page[i].name != wide[j].name or (before >= 0 and j <= before and not any(s <= j and before <= e for s, e in loops)):
                ok = False
                break
            score += 1 + (brute_force(page[i].kids, wide[j].kids, wide[j].loops) if page[i].kids is not None else 0)
            before = j
        if ok:
            best = max(best, score)
    return best


def test_embedding_is_brute_force():
    rng = random.Random(3)
    for _ in range(80):
        make = lambda n: [tree(random_tree(rng, 2, ["<a>", "<b>"])) for _ in range(rng.randrange(n))]
        page, wide = make(4), make(5)
        loops = [] if len(wide) < 2 else rng.choice([[], [(0, 1)], [(0, 0), (0, len(wide) - 1)], [(len(wide) - 2, len(wide) - 1)]])
        assert wrapper.embedding(page, wide, loops)[0] == brute_force(page, wide, loops)


def test_mismatches_become_optional_or_repeated():
    say = lambda *specs: wrapper.pattern(wrapper.decoded(wrapper.inferred([wrapper.encoded(folded(("", list(s)))) for s in specs])))
    p, h, d, n = ("p", ["#"]), ("h", ["#"]), ("d", ["#"]), ("n", [])
    assert say([h, d], [h, d]) == "h#/hd#/d/"
    assert say([h, d], [h]) == "h#/h(?:d#/d)?/"
    assert say([h, d, d], [h, d]) == "h#/h(?:d#/d)+/"
    assert say([h, d, n, d, n], [h, d, n]) == "h#/h(?:(?:d#/d)?(?:n/n)?)+/"
    assert say([d, d], [d, d]) == "d#/dd#/d/"
    assert say([p, p], [p, p]) == "p#/pp#/p/"
