"""Parts that need no Spark, held against rules stated here: exhaustive small alphabets, generated schemas, lists and trees."""

import json
import re
from dataclasses import replace
from itertools import product

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from branchframe.engine import grants as g
from branchframe.errors import CancelledError, EngineError, InvalidError, PermissionDeniedError, WrongKindError, guarded, scrub
from branchframe.functions import jsontext
from branchframe.functions.locations import Location, encode_location, parse_location
from branchframe.operators.sequence import MAX_SEQUENCE_EDITS, align, merge_sequences, merge_trees
from branchframe.plans.schema import _WIDER, TYPES, Column, Index, Schema, check_alterable, merge_schemas

# Schemas: generated ones, and edits of one attribute each

_KINDS = sorted(set(TYPES) - {"varchar"})


@st.composite
def schemas(draw):
    n = draw(st.integers(2, 5))
    columns = [Column(1, "key", "int8")]
    for tag in range(2, n + 1):
        kind = draw(st.sampled_from(["int2", "int4", "float4", "varchar", "bytea"]))
        columns.append(Column(tag, f"col{tag}", kind, draw(st.booleans()), 40 if kind == "varchar" else 0))
    indexes = tuple(Index(100 + t, (t,)) for t in draw(st.sets(st.integers(2, n), max_size=2)))
    return Schema(tuple(columns), (1,), indexes)


def edited(schema, tag, attribute, value):
    return replace(schema, columns=tuple(replace(c, **{attribute: value}) if c.tag == tag else c for c in schema.columns))


@st.composite
def edits(draw, schema):
    """An edit as (what it touches, the schema after it); what both sides may do at once touches different things."""
    column = draw(st.sampled_from(schema.columns[1:]))
    wider = sorted(b for a, b in _WIDER if a == column.type)
    choice = draw(st.sampled_from(["name", "nullable", "new", "index", *(["type"] if wider else []), *(["max_len"] if column.type == "varchar" else [])]))
    if choice == "name":
        return (column.tag, "name"), edited(schema, column.tag, "name", f"col{column.tag}{draw(st.sampled_from('xyz'))}")
    if choice == "nullable":
        return (column.tag, "nullable"), edited(schema, column.tag, "nullable", not column.nullable)
    if choice == "type":
        kind = draw(st.sampled_from(wider))
        changed = edited(schema, column.tag, "type", kind)
        return (column.tag, "type"), edited(changed, column.tag, "max_len", 0) if column.type == "varchar" else changed
    if choice == "max_len":
        return (column.tag, "type"), edited(schema, column.tag, "max_len", draw(st.integers(41, 60)))
    if choice == "new":
        tag = draw(st.integers(20, 22))
        return (tag, "new"), replace(schema, columns=(*schema.columns, Column(tag, f"new{tag}", draw(st.sampled_from(_KINDS)), True)))
    tag = draw(st.integers(200, 202))
    return (tag, "index"), replace(schema, indexes=(*schema.indexes, Index(tag, (column.tag,))))


@given(st.data())
def test_edits_of_different_things_all_land(data):
    base = data.draw(schemas())
    (at, ours), (there, theirs) = data.draw(edits(base)), data.draw(edits(base))
    merged, clashes = merge_schemas(base, ours, theirs)
    if at != there:
        assert not clashes
        for column in merged.columns:
            b, o, t = (s.column(column.tag) for s in (base, ours, theirs))
            if b is None:
                assert column == (o or t)
                continue
            for attribute in ("name", "type", "nullable", "max_len"):
                versions = [getattr(x, attribute) for x in (b, o, t)]
                assert getattr(column, attribute) == (versions[1] if versions[1] != versions[0] else versions[2])
        assert {x.tag for x in merged.indexes} == {x.tag for s in (ours, theirs) for x in s.indexes}
    elif ours == theirs:
        assert merged == ours and not clashes
    else:
        place = f"schema/index/{at[0]}" if at[1] == "index" else f"schema/{at[0]}"
        assert merged is None and [c.location for c in clashes] == [place] and all(c.reason for c in clashes)


@given(st.data())
def test_one_sided_edits_win_and_sides_may_swap(data):
    base = data.draw(schemas())
    _, ours = data.draw(edits(base))
    _, theirs = data.draw(edits(base))
    assert merge_schemas(base, ours, base)[0] == ours and merge_schemas(base, base, theirs)[0] == theirs
    there, back = merge_schemas(base, ours, theirs), merge_schemas(base, theirs, ours)
    assert [c.location for c in there[1]] == [c.location for c in back[1]]
    if there[0] is not None:
        assert sorted(map(repr, there[0].columns)) == sorted(map(repr, back[0].columns))


@given(st.data())
def test_a_dropped_column_takes_its_index_and_clashes_with_its_edit(data):
    base = data.draw(schemas())
    gone = data.draw(st.sampled_from(base.columns[1:])).tag
    ours = replace(base, columns=tuple(c for c in base.columns if c.tag != gone), indexes=tuple(x for x in base.indexes if gone not in x.columns))
    at, theirs = data.draw(edits(base))
    merged, clashes = merge_schemas(base, ours, theirs)
    if at[0] == gone and at[1] != "index":
        assert merged is None and [c.location for c in clashes] == [f"schema/{gone}"]
    else:
        assert not clashes and merged.column(gone) is None and all(gone not in x.columns for x in merged.indexes)


@given(schemas(), schemas())
def test_other_keys_and_required_new_columns_have_no_merge(base, other):
    required = replace(base, columns=(*base.columns, Column(30, "must", "bool")))
    assert [c.location for c in merge_schemas(base, base, required)[1]] == ["schema"]
    moved = replace(edited(base, 2, "nullable", False), primary_key=(2,))
    assert [c.location for c in merge_schemas(base, base, moved)[1]] == ["schema"]


@given(schemas())
def test_what_no_table_can_be(base):
    base.validate()
    column = base.columns[-1]
    spoiled = [
        replace(base, columns=()), replace(base, columns=(*base.columns, replace(column, name="twin"))), replace(base, columns=(*base.columns, replace(column, tag=9))),
        edited(base, column.tag, "tag", 0), edited(base, column.tag, "name", ""), edited(base, column.tag, "name", "é" * 65), edited(base, column.tag, "type", "decimal"),
        edited(edited(base, column.tag, "type", "varchar"), column.tag, "max_len", 0), edited(edited(base, column.tag, "type", "text"), column.tag, "max_len", 5),
        replace(base, primary_key=(1, 1)), replace(base, primary_key=(77,)), replace(edited(base, column.tag, "nullable", True), primary_key=(column.tag,)),
        replace(base, indexes=(Index(7, ()),)), replace(base, indexes=(Index(7, (1, 1)),)), replace(base, indexes=(Index(7, (88,)),)), replace(base, indexes=tuple(Index(i + 1, (1,)) for i in range(65))),
    ]
    for bad in spoiled:
        with pytest.raises(InvalidError):
            bad.validate()


def test_only_listed_types_widen():
    for old, new in product(sorted(TYPES), sorted(TYPES)):
        sides = [Schema((Column(1, "key", "int8"), Column(2, "x", kind, True, 9 if kind == "varchar" else 0)), (1,)) for kind in (old, new)]
        if old == new or (old, new) in _WIDER:
            check_alterable(*sides)
        else:
            with pytest.raises(InvalidError):
                check_alterable(*sides)


# JSON: all short numbers, and generated documents in odd spellings

_GRAMMAR = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")


def test_numbers_are_what_the_grammar_says():
    for size in range(1, 5):
        for letters in product("019.eE+-", repeat=size):
            text = "".join(letters)
            if _GRAMMAR.fullmatch(text):
                mantissa, _, exponent = text.lower().partition("e")
                value = jsontext.encode(jsontext.parse(text))
                assert _GRAMMAR.fullmatch(value) and "e" not in value and jsontext.encode(jsontext.parse(value)) == value
                if abs(int(exponent or 0)) < 300:
                    assert float(value) == pytest.approx(float(text)) and not value.endswith(".0") and value != "-0"
            else:
                with pytest.raises(InvalidError):
                    jsontext.parse(text)


_LETTERS = st.text(st.characters(exclude_categories=["Cs"]), max_size=6)
_VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | _LETTERS, lambda x: st.lists(x, max_size=4) | st.dictionaries(_LETTERS, x, max_size=4), max_leaves=12)


def plain(value):
    """What is expected of a Python value: fields by the bytes of their names, nothing between tokens."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{plain(k)}:{plain(value[k])}" for k in sorted(value, key=str.encode)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(plain, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


@given(_VALUES, st.booleans(), st.sampled_from([None, 1, 3]))
def test_every_spelling_of_a_document_has_one_canonical_text(value, ascii_only, indent):
    text = json.dumps(value, ensure_ascii=ascii_only, indent=indent)
    canonical = jsontext.encode(jsontext.parse(f" \n\t{text}\r "))
    assert json.loads(canonical) == value and jsontext.encode(jsontext.parse(canonical)) == canonical
    assert canonical.replace("\\u007f", "\x7f") == plain(value).replace("\\u007f", "\x7f")


@given(st.dictionaries(_LETTERS, _VALUES, min_size=1, max_size=3), st.data())
def test_parts_and_blends_of_documents_are_none(value, data):
    text = json.dumps(value)
    for bad in (text[: data.draw(st.integers(0, len(text) - 1))], text + data.draw(st.sampled_from("{}[],:x1")), text[1:], f"[{text},]", f"{text}//", "{" + text[1:-1] + "," + text[1:-1] + "}"):
        with pytest.raises(InvalidError):
            jsontext.parse(bad)


def test_limits_of_documents():
    deep = jsontext.MAX_DEPTH
    jsontext.parse("[" * deep + "]" * deep)
    jsontext.parse('{"k":' * deep + "0" + "}" * deep)
    tail = "1" * 1000
    assert jsontext.encode(jsontext.parse(tail)) == tail
    wrong = ["[" * (deep + 1) + "]" * (deep + 1), tail + "1", "7e1000", "7e-1001", "7e999999999", '"' + "y" * (1 << 20) + '"', "0" + " " * (1 << 20)]
    lone = [rf'"\u{a:04x}"' for a in (0xD800, 0xDBFF, 0xDC00, 0xDFFF)] + [r'"\uD834x"', r'"\ud834 "', r'"\u00g0"', r'"\x41"']
    for bad in [*wrong, *lone, b'["\xc3"]', b'"\xed\xa0\x80"', '"\x1f"', "True", "Infinity", "-Infinity", "nul", "'q'", "{1:2}", "[1 2]", "{}{}"]:
        with pytest.raises(InvalidError):
            jsontext.parse(bad)


# Lists

short = st.lists(st.sampled_from("pqr"), max_size=7)


@given(short, short)
def test_alignment_is_as_long_as_can_be(a, b):
    found = sorted(align(a, b).items())
    assert all(a[i] == b[j] for i, j in found) and all(x < y for (_, x), (_, y) in zip(found, found[1:], strict=False))
    longest = {(): 0}

    def common(x, y):
        if not x or not y:
            return 0
        if (x, y) not in longest:
            longest[x, y] = max(common(x[1:], y), common(x, y[1:]), 1 + common(x[1:], y[1:]) if x[0] == y[0] else 0)
        return longest[x, y]

    assert len(found) == common(tuple(a), tuple(b))


@given(short, short, short)
def test_lists_keep_the_laws_of_merging(base, ours, theirs):
    assert merge_sequences(base, ours, base).value == ours and merge_sequences(base, base, theirs).value == theirs and merge_sequences(base, ours, ours).value == ours
    there, back = merge_sequences(base, ours, theirs), merge_sequences(base, theirs, ours)
    assert there.value == back.value and [p for p, _ in there.conflicts] == [p for p, _ in back.conflicts]


#: An edit of a place of a list: the item there becomes these, with other items put before it.
_EDIT = st.sampled_from(["keep", "drop", "swap", "add"])


def apply_edits(n, edits, mark):
    out = []
    for i in range(n):
        what = edits.get(i, "keep")
        out += {"keep": [i], "drop": [], "swap": [f"{mark}{i}"], "add": [f"{mark}{i}", i]}[what]
    return out


@given(st.integers(3, 24), st.data())
def test_edits_apart_from_each_other_all_land(n, data):
    places = [i for i in range(0, n, 3)]
    owner = {i: data.draw(st.sampled_from("ot")) for i in places}
    edits = {i: data.draw(_EDIT) for i in places}
    sides = {who: apply_edits(n, {i: e for i, e in edits.items() if owner[i] == who}, "new") for who in "ot"}
    got = merge_sequences(list(range(n)), sides["o"], sides["t"], str)
    assert got.value == apply_edits(n, edits, "new") and not got.conflicts and not got.flagged


@given(st.integers(5, 20), st.data())
def test_two_edits_of_one_place_clash_or_stand_side_by_side(n, data):
    at = data.draw(st.integers(1, n - 2))
    base, one, two = list(range(n)), data.draw(_EDIT), data.draw(_EDIT)
    assume("keep" not in (one, two))
    got = merge_sequences(base, apply_edits(n, {at: one}, "a"), apply_edits(n, {at: two}, "b"), str)
    if one == two == "add":
        assert got.value == [*range(at), f"a{at}", f"b{at}", *range(at, n)] and [p for p, _ in got.flagged] == [(str(at),)] and not got.conflicts
    elif one == two == "drop":
        assert got.value == [*range(at), *range(at + 1, n)] and not got.conflicts and not got.flagged
    else:
        assert got.value == base and [p for p, _ in got.conflicts] == [(str(at),)]


@pytest.mark.parametrize("over", [0, 1])
def test_a_list_edited_too_much_stays_as_it_was(over):
    base = [-i for i in range(1, 301)]
    ours = [*range(MAX_SEQUENCE_EDITS + over), *base]
    got = merge_sequences(base, ours, [*base, "end"], str)
    assert ([p for p, _ in got.conflicts], got.value) == ([()], base) if over else (got.conflicts == [] and got.value == [*ours, "end"])


# Trees

_PATHS = [("a",), ("b", "x"), ("b", "y"), ("c", "x", "deep"), ("c", "z")]


def tree(values):
    out = {}
    for path, value in values.items():
        here = out
        for step in path[:-1]:
            here = here.setdefault(step, {})
        here[path[-1]] = value
    return out


_LEAF = st.integers(0, 3).map(jsontext.Number) | st.sampled_from(["s", "u", True, None])


@settings(max_examples=200)
@given(st.fixed_dictionaries({p: st.tuples(_LEAF, _LEAF, _LEAF) for p in _PATHS}))
def test_trees_merge_leaf_by_leaf(leaves):
    base, ours, theirs = (tree({p: v[i] for p, v in leaves.items()}) for i in range(3))
    got = merge_trees(base, ours, theirs, lambda path: path == ("c", "z"))
    want, clashes = {}, []
    for path, (b, o, t) in leaves.items():
        eb, eo, et = map(jsontext.encode, (b, o, t))
        if eo == et or et == eb:
            want[path] = o
        elif eo == eb:
            want[path] = t
        elif path == ("c", "z") and all(isinstance(v, jsontext.Number) for v in (b, o, t)):
            want[path] = jsontext.Number(int(o) + int(t) - int(b))
        else:
            want[path] = b
            clashes.append(path)
    assert jsontext.encode(got.value) == jsontext.encode(tree(want)) and sorted(p for p, _ in got.conflicts) == sorted(clashes)


@given(st.dictionaries(st.sampled_from("klmn"), st.tuples(st.booleans(), st.booleans(), st.booleans(), _LEAF, _LEAF), min_size=1))
def test_fields_that_come_and_go(fields):
    """Each field is there or not in base, ours, theirs, with one value in base and another one where a side has changed it."""
    sides = [{}, {}, {}]
    for name, (in_base, in_ours, in_theirs, old, new) in fields.items():
        for side, there, value in zip(sides, (in_base, in_ours, in_theirs), (old, old, new), strict=True):
            if there:
                side[name] = value
    got, want, clashes = merge_trees(*sides), {}, []
    for name in fields:
        b, o, t = (jsontext.encode(s[name]) if name in s else None for s in sides)
        keep = o if o == t or t == b else t if o == b else b
        if not (o == t or t == b or o == b):
            clashes.append((name,))
        if keep is not None:
            want[name] = keep
    assert {n: jsontext.encode(v) for n, v in got.value.items()} == want and sorted(p for p, _ in got.conflicts) == sorted(clashes)


def test_lists_in_trees_and_wholes():
    lists = merge_trees({"q": {"l": ["a", "b"]}}, {"q": {"l": ["0", "a", "b"]}}, {"q": {"l": ["a", "b", "z"]}})
    assert lists.value == {"q": {"l": ["0", "a", "b", "z"]}} and not lists.conflicts
    both = merge_trees({"l": ["a"]}, {"l": ["a", "y"]}, {"l": ["a", "x"]})
    assert both.value == {"l": ["a", "x", "y"]} and [p for p, _ in both.flagged] == [("l", "1")]
    assert [p for p, _ in merge_trees("r", "s", "t").conflicts] == [()] and merge_trees([], {}, []).value == {}
    deep = json.loads("[" * 70 + "]" * 70)
    assert [p for p, _ in merge_trees({}, {"d": deep}, {"e": 1}).conflicts] == [()]


# Grants, errors, locations

def test_scopes_hold_only_their_permissions_and_nothing_implies_another():
    scopes = {g.DATABASE: g.Scope(), g.BRANCH: g.Scope(g.BRANCH, "b1"), g.OBJECT: g.Scope(g.OBJECT, "b1", "t1")}
    may = {g.READ: 3, g.WRITE: 3, g.COMMIT: 2, g.MERGE: 2, g.BRANCH_ADMIN: 2, g.ADMIN: 1}  # of how many kinds of scope, from the widest on
    for permission, (number, (kind, scope)) in product(may, enumerate(scopes.items(), 1)):
        held = g.Grants()
        if number > may[permission]:
            with pytest.raises(InvalidError):
                held.grant("p", permission, scope)
            continue
        held.grant("p", permission, scope)
        for asked, branch, path in product(may, (None, "b1", "b2"), (None, "t1", "t2")):
            if branch is None and path is not None:
                continue
            inside = kind == g.DATABASE or (branch == "b1" and (kind == g.BRANCH or (path in (None, "t1") and permission in (g.READ, g.WRITE))))
            reading_the_whole = branch is None and permission == g.READ
            assert held.allows("p", g.Question(asked, branch, path)) == (asked == permission and (inside or reading_the_whole)), (permission, kind, asked, branch, path)
        assert not held.allows("q", g.Question(permission, "b1", "t1"))
        held.revoke("p", permission, scope)
        with pytest.raises(PermissionDeniedError):
            held.ask("p", g.Question(permission, "b1", "t1"))


def test_protected_branches_take_no_writes():
    held = g.Grants()
    held.grant("p", g.WRITE)
    held.grant("p", g.MERGE)
    held.protect("b1")
    asked = g.Question(g.WRITE, "b1", "t"), g.Question(g.WRITE, "b2", "t"), g.Question(g.MERGE, "b1")
    assert [held.allows("p", q) for q in asked] == [False, True, True]
    held.unprotect("b1")
    assert all(held.allows("p", q) for q in asked)
    for scope in (g.Scope(g.BRANCH), g.Scope(g.OBJECT, "b1"), g.Scope(g.DATABASE, "b1"), g.Scope("cell")):
        with pytest.raises(InvalidError):
            held.grant("p", g.READ, scope)


def test_errors_leave_as_kind_and_code_from_the_outermost_call_only():
    log = []

    @guarded(lambda self: lambda code, detail: log.append((code, detail)))
    class Thing:
        def inner(self):
            raise WrongKindError("the value 17 of row 4")

        def outer(self):
            try:
                self.inner()
            except WrongKindError as error:
                assert "17" in str(error)
                raise

    with pytest.raises(WrongKindError) as caught:
        Thing().outer()
    assert "17" not in str(caught.value) and len(log) == 1 and log[0][0] in str(caught.value) and "row 4" in log[0][1]
    assert scrub(caught.value) is caught.value and isinstance(scrub(KeyError("k")), EngineError) and CancelledError.kind == "Cancelled"


_KEYS = st.tuples(st.integers() | st.booleans() | st.none() | _LETTERS | st.binary(max_size=5))
_BELOW = st.none() | st.integers(1, 99) | _LETTERS | st.lists(_LETTERS, max_size=3).map(tuple)


@given(_KEYS | st.tuples(st.integers(), _LETTERS), _BELOW)
def test_places_have_one_text_and_no_other_parses(key, below):
    place = Location(key, below)
    text = encode_location(place)
    assert parse_location(text) == place
    for other in (text.replace(",", ", ", 1), text + " ", text[:-1], text.replace("[[", "[ [", 1), text[1:]):
        if other != text:
            with pytest.raises(InvalidError):
                parse_location(other)


@given(st.integers(1, 10**6))
def test_places_in_schemas(tag):
    for text in ("schema", f"schema/{tag}", f"schema/index/{tag}"):
        assert encode_location(parse_location(text)) == text
    for bad in (f"schema/0{tag}", f"schema/{tag}/", "schema/index", f"schema/-{tag}", f"schema/key/{tag}", f"Schema/{tag}"):
        with pytest.raises(InvalidError):
            parse_location(bad)
