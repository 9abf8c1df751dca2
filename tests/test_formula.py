import math

import pytest

from marginflow.formula import analysis
from marginflow.formula.nodes import Node, always, const, label, postorder, predicate, var
from marginflow.formula.parser import parse


def test_precedence_of_logic():
    f = parse("x>0 or y>0 and not z>0 U[0,1] w>0")
    assert f.kind == "or" and f.children[1].kind == "and" and f.children[1].children[1].kind == "until"
    assert f.children[1].children[1].children[0].kind == "not"


def test_left_association():
    f = parse("a>0 and b>0 and c>0")
    assert f.children[0].kind == "and" and f.children[1].kind == "predicate"


def test_until_does_not_chain():
    with pytest.raises(ValueError):
        parse("a>0 U[0,1] b>0 U[0,1] c>0")
    assert parse("(a>0 U[0,1] b>0) U[0,1] c>0").kind == "until"


def test_temporal_operators_need_parentheses():
    with pytest.raises(ValueError):
        parse("G[0,1] x>0")
    assert parse("G[0,1](x>0)").interval == (0.0, 1.0)


def test_operator_letters_may_be_variables():
    assert analysis.variables(parse("G + F > U")) == {"G", "F", "U"}


def test_unary_minus_is_an_atom():
    p = parse("-x^2 >= 0").attrs["left"]
    assert p.kind == "^" and p.children[0].kind == "*"


def test_power_is_right_associative_and_products_left():
    p = parse("a^b^c - d/e/f > 0").attrs["left"]
    assert label(p) == "((a ^ (b ^ c)) - ((d / e) / f))"


@pytest.mark.parametrize("text", ["", "x", "x >", "x != 3", "G[1](x>0)", "G[0,-1](x>0)", "(x>0", "x > 0)", "and x > 0", "x > 0 x", "F[0,1]x>0", "x $ 3"])
def test_rejects(text):
    with pytest.raises(ValueError):
        parse(text)


def test_parenthesised_arithmetic_and_logic():
    assert parse("((x) + (1)) >= (2)").kind == "predicate"
    assert parse("((x >= 0))").kind == "predicate"
    assert parse("((x + 1) >= 0 and (y > 0)) or (z < 1)").kind == "or"


def test_sections():
    f = parse("[predicates]\np = x >= 3\nq = y < 2\np = x >= 4\n[stl]\nG[0,2](p and q) or p\n")
    assert f.kind == "or" and f.children[1].attrs["name"] == "p"
    assert f.children[1].attrs["right"].attrs["value"] == 4.0
    with pytest.raises(ValueError):
        parse("[predicates]\np = x > 0\n[stl]\nq")


def test_inline_names():
    f = parse("x>0 and y>0")
    assert [c.attrs["name"] for c in f.children] == ["__inline_predicate_0", "__inline_predicate_1"]


def test_interval_order_is_checked_when_used():
    f = parse("G[3,1](x>0)")
    with pytest.raises(ValueError):
        _ = f.interval
    with pytest.raises(ValueError):
        _ = always(predicate(var("x"), ">", const(0)), None).interval


def test_analyses():
    f = parse("G[0,5]((x > 0) and F[0,2](y > 0)) or (x > 1) U[1,3] (y == 2)")
    assert analysis.horizon(f) == 7 and analysis.required_max_gap(f) == 2
    assert analysis.operators_in(f) == {"or", "always", "and", "eventually", "until"}
    assert analysis.has_equality(f) and not analysis.is_principled(f)
    assert analysis.temporal_depth(f) == 2
    assert analysis.horizon(parse("x>0")) == 0 and analysis.required_max_gap(parse("x>0")) == math.inf
    assert analysis.on_grid(f, 0.5) and not analysis.on_grid(f, 0.3)


def test_affine():
    p = parse("2*x - (y + 3)/2 >= x + 1")
    assert analysis.affine(p.attrs["left"]) == (-1.5, {"x": 2.0, "y": -0.5})
    assert analysis.predicate_norm(p) == pytest.approx(math.hypot(1, 0.5))
    for text in ("x*y >= 0", "1/x >= 0", "x^2 >= 0", "2^2 >= x", "abs(x) >= 0", "3 >= 2"):
        with pytest.raises(NotImplementedError):
            analysis.predicate_norm(parse(text))


def test_nodes():
    with pytest.raises(ValueError):
        Node("xor")
    f = parse("G[0,1](x + 1 >= 2)")
    assert [n.kind for n in postorder(f)] == ["var", "const", "+", "const", "predicate", "always"]
    assert [n.kind for n in postorder(f, False)] == ["predicate", "always"]
    assert str(f) == "G[0,1](((x + 1) >= 2))"
    assert str(parse(str(f))) == str(f)


def test_text_of_random_formulas_reads_back():
    import random

    from marginflow.plans.generate import random_formula

    rng = random.Random(7)
    for _ in range(300):
        f = random_formula(rng, 3, 12)
        g = parse(str(f))
        # a negative constant reads as a product with -1
        assert ("-" in str(f) or str(g) == str(f)) and analysis.horizon(g) == analysis.horizon(f) and analysis.operators_in(g) == analysis.operators_in(f)
