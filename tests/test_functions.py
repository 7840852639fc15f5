import pytest

from siltstone.operators.blocks import lifetimes, switches
from siltstone.operators.functions import extents

CASES = [
    ("go", "func A() {\n\tx()\n}\n", [("A", 1, 3)]),
    ("go", "func (s *S) B(a int)\n{\n\tx()\n}\n", [("B", 1, 4)]),
    ("go", "func C() {}\nfunc D() {\n\tx()\n}\n", [("D", 2, 3)]),
    ("go", "func E() {\n\tx()\n", []),
    ("go", "// func F() {\n// }\n", []),
    ("python", "def a():\n    x\n\ndef b():\n    def c():\n        y\n    z\n", [("a", 1, 3), ("c", 5, 2), ("b", 4, 4)]),
    ("python", "class K:\n\tasync def m(self):\n\t\tx\n\ty = 1\n", [("m", 2, 2)]),
    ("ruby", "def self.go(x)\n  if x\n    y\n  end\nend\n", [("go", 1, 5)]),
    ("javascript", "const run = (x) => {\n  y();\n};\nfunction two(a) {\n  z();\n}\n", [("const run =", 1, 3), ("two", 4, 3)]),
    ("typescript", "class K {\n  async load(id) {\n    x();\n  }\n}\n", [("load", 2, 3)]),
    ("java", "public int size() {\n  return 1;\n}\n", [("size", 1, 3)]),
    ("rust", "pub async fn go(x: u8) {\n  y();\n}\n", [("go", 1, 3)]),
    ("swift", "private func go(x: Int) {\n  y()\n}\n", [("go", 1, 3)]),
    ("kotlin", "override fun <T> go(x: T): Int {\n  y()\n}\n", [("go", 1, 3)]),
    ("cpp", "int K::size(int a) {\n  return 1;\n}\nK::~K() {\n  x();\n}\n", [("size", 1, 3), ("~K", 4, 3)]),
    ("go", "", []),
]


@pytest.mark.parametrize(("lang", "source", "want"), CASES)
def test_extents(lang, source, want):
    assert extents(source, lang) == want


def test_switches():
    lines = ["switch x {"] + [f"case {k}:" for k in range(3)] + ["default:", "}", "y", "match z:", "    case 1", "    case 2", "w"]
    assert switches(lines) == [(1, 6, 4), (8, 10, 2)]


def test_lifetimes():
    body = ["total := 0", *["x()"] * 5, "use(total)", "use(total)"]
    assert lifetimes(body, 1, 5) == [("total", 1, 7)]
    assert lifetimes(["total := 0", "use(total)", *["x()"] * 5, "use(total)"], 1, 5) == [("total", 2, 8)]
    assert lifetimes(["x"] * 3, 1, 5) == []
