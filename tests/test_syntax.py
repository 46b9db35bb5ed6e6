import pytest

from scriptorium.errors import QueryError
from scriptorium.plans.syntax import And, Near, Not, Or, Phrase, Term, is_natural, parse

a, b, c = Term("a"), Term("b"), Term("c")


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a", a),
        ("a AND b AND c", And((a, b, c))),
        ("a OR b OR c", Or((a, b, c))),
        ("a OR b AND c", Or((a, And((b, c))))),
        ("a b AND c", Or((a, And((b, c))), natural=True)),
        ("a AND b c", And((a, Or((b, c), natural=True)))),
        ("NOT a AND b", And((Not(a), b))),
        ("NOT NOT a", Not(Not(a))),
        ("(a OR b) AND c", And((Or((a, b)), c))),
        ('"a b c"', Phrase(("a", "b", "c"))),
        ("#2(a, b)", Near(2, "a", "b")),
        ("#0(a,b) AND c", And((Near(0, "a", "b"), c))),
        ("ANDROID ORACLE", Or((Term("ANDROID"), Term("ORACLE")), natural=True)),
        ("field:Some_Välue", Term("field:Some_Välue")),
    ],
)
def test_trees(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "  ", "a AND", "(a", "a)", '"a', '""', "#2(a)", "a - b", "OR a", "#(a,b)"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_natural():
    assert is_natural(parse("a b c"))
    assert not is_natural(parse("a"))
    assert not is_natural(parse("a b AND c"))
    assert not is_natural(parse('"a b" c'))
    assert not is_natural(parse("a OR b"))
