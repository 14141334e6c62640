from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import encoding, leakage, linkage, lookalike, names, packing

words = st.text(alphabet="aäbcdöeéfgåhø ", min_size=1, max_size=20)
anything = st.text(max_size=60)


@settings(max_examples=200, deadline=None)
@given(anything)
def test_no_text_breaks_the_readers(text):
    found, restored, wrong = encoding.repair(text)
    assert found == bool(wrong) and (found or restored == text)
    assert encoding.repair(restored)[0] in (True, False)
    linkage.read_title(text)
    linkage.read_year(text)
    assert "" not in linkage.read_names([text, None])
    reduced, at = leakage.reduce_mapped(text)
    assert len(reduced) == len(at) and at == sorted(at)
    names.Catalogue([(1, text or "x", text or "x", "A")]).resolve(text)


@settings(max_examples=200, deadline=None)
@given(words)
def test_utf8_read_as_windows_comes_back(text):
    garbled = text.encode().decode("cp1252", "replace")
    if "�" not in garbled and not text.isascii():
        assert encoding.repair(garbled)[1] == text


@settings(max_examples=200, deadline=None)
@given(st.lists(anything, min_size=1, max_size=4))
def test_rewriting_twice_is_rewriting_once(texts):
    counts = {}
    for t in texts:
        for x in [*t, *lookalike._MARKED.findall(t)]:
            counts[x] = counts.get(x, 0) + 1
    own = lookalike.Rewriter(lookalike.representatives(counts))
    for t in texts:
        assert len(own(t)) <= 4 * len(t) + 4
        if all(len(x) == 1 for x in counts):
            assert own(own(t)) == own(t) or any(lookalike.plain_form(x) is not None for x in own(t))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 300), max_size=12))
def test_every_piece_gets_a_place(histogram):
    slots, bins = packing.plan(histogram, 40)
    placed, fill = {}, {}
    ranges = {}
    for length, first, container, k in slots:
        ranges.setdefault(length, []).append((first, container, k))
    for length, n in histogram.items():
        if not length:
            continue
        own = sorted(ranges[length])
        for rank in range(n):
            first, container, k = max(x for x in own if x[0] <= rank)
            at = container + (rank - first) // k
            fill[at] = fill.get(at, 0) + length
            placed[length] = placed.get(length, 0) + 1
    assert all(x <= 40 for x in fill.values()) and len(fill) == bins
    assert placed == {x: n for x, n in histogram.items() if x}
