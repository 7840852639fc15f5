"""Small code files that the driver's tables don't hold, the same rows for Spark and for SQL."""

from __future__ import annotations

DEEP = "package a\n\nfunc Deep(x int) {\n\tif x > 0 {\n\t\tfor x < 9 {\n\t\t\tif x == 3 {\n\t\t\t\tif x == 4 {\n\t\t\t\t\tswitch x {\n\t\t\t\t\t}\n\t\t\t\t}\n\t\t\t}\n\t\t}\n\t}\n}\n"
BUMPS = (
    "package a\n\nfunc Bumps(x int) {\n\tif x > 0 {\n\t\tx++\n\t\tx--\n\t\tx++\n\t\tx--\n\t}\n\tx = 1\n\tif x > 1 {\n\t\tfor x < 3 {\n\t\t\tx++\n\t\t\tx--\n\t\t}\n\t}\n}\n\nfunc tiny() {\n}\n\nfunc (s *Server) Wide(a int, b string, c bool, d float64) {\n\ts.One(a).Two(b).Three(c).Four(d)\n\treturn\n}\n"
)
CONDITION = "def pick(a, b, c, d, e):\n    if a && b || c && d:\n        return 1\n    while a || b || c:\n        pass\n    return 0\n\nasync def many(a, b, c, d, e, f, g, h):\n    x = 1\n    return x\n"
GLOBALS = "var a = 1\nvar b = 2\nconst c = 3\nd = 4\ne = 5\nfunc f() {\n  g = 6\n}\nh = 7\n"
COMMENTS = "".join(f"# note {k}\nx{k} = {k}\n" for k in range(6))
SWITCH = "func pick(x int) int {\n\tswitch x {\n" + "".join(f"\tcase {k}:\n\t\treturn {k}\n" for k in range(12)) + "\tdefault:\n\t\treturn 0\n\t}\n}\n"
LONG = "func Long(x int) int {\n\ttotal := 0\n" + "".join(f"\tx = x + {k}\n" for k in range(90)) + "\treturn total + x\n}\n"
TWINS = "".join(f"func {name}(items []Order, limit int) int {{\n\tcount := 0\n\tfor _, item := range items {{\n\t\tif item.Price > limit {{\n\t\t\tcount = count + 1\n\t\t}}\n\t\tif item.Amount == 0 {{\n\t\t\tcontinue\n\t\t}}\n\t}}\n\treturn count\n}}\n\n" for name in ("First", "Second"))
LOOSE = "".join(f"func F{k}(x *Type{k}) {{\n\tx.Run()\n\tx.Stop()\n}}\n\n" for k in range(6))
BIG = "".join(f"func B{k}() {{\n" + "\tx = 1\n" * 38 + "}\n" for k in range(26))
PY_RISKS = (
    "import os\nimport pickle as pk\nimport subprocess\n\n# eval(x) in a comment\ndef run(cmd, data):\n    os.system(cmd)\n    subprocess.run(cmd)\n    exec(data)\n    yaml.load(data)\n    requests.get(cmd, verify=False)\n    db.execute(f'select {data}')\n    return pk.loads(data)\n\ndef hash(data):\n    return hashlib.md5(data)\n"
)
JS_RISKS = "const run = (x) => {\n  child_process.exec(x);\n  eval(x);\n  el.innerHTML = x;\n  fetch(x);\n};\nnew Function(x);\ndb.query('select ' + x);\n"
GO_RISKS = 'func get(u string) {\n\thttp.Get(u)\n\texec.Command("sh", u)\n\tfilepath.Join(u, "a")\n}\n// template.HTML(u)\n'
WORKFLOW = "on:\n  pull_request_target:\n    branches: [main]\n"

FILES = [
    ("fix/deep.go", "go", DEEP),
    ("fix/bumps.go", "go", BUMPS),
    ("fix/condition.py", "python", CONDITION),
    ("fix/globals.go", "go", GLOBALS),
    ("fix/comments.py", "python", COMMENTS),
    ("fix/switch.go", "go", SWITCH),
    ("fix/long.go", "go", LONG),
    ("fix/twins.go", "go", TWINS),
    ("fix/loose.go", "go", LOOSE),
    ("fix/big.go", "go", BIG),
    ("fix/risks.py", "python", PY_RISKS),
    ("fix/risks.js", "javascript", JS_RISKS),
    ("fix/risks.go", "go", GO_RISKS),
    ("fix/.github/workflows/ci.yml", "yaml", WORKFLOW),
    ("fix/notes.go", "go", "// Teh lenght is definately seperate, teh end\nx := recieve()\n"),
    ("fix/empty.go", "go", ""),
    ("fix/newline.go", "go", "\n"),
]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    """Rows as the body of a SQL VALUES clause."""
    cell = lambda x: "NULL" if x is None else text(x) if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
