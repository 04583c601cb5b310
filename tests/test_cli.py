import io

from tuplequarry import queries
from tuplequarry.cli import main
from tuplequarry.testing import encoder as enc


def run(*args):
    out = io.StringIO()
    code = main([str(x) for x in args], out)
    return code, out.getvalue().splitlines()


def test_commands(spark, tmp_path, capsys):
    root = queries.write_catalogs(str(tmp_path / "d"))
    base = f"{root}/base/{queries.DB}"
    path = f"{base}/{queries.BASE + 101}"
    rows = [(k, k * 2, "O", 1.5, 0, "x,y" if k % 2 else None) for k in range(1, 51)]
    enc.write_relation(path, queries.ORDERS.columns, rows, flags=lambda r: queries.state(r[0]))
    live = [k for k in range(1, 51) if k % 11 and k % 7]
    assert run(path, "--count") == (0, [f"-- rows: {len(live)}"])
    code, lines = run(path, "--data", "--header", "--fields", "o_orderpriority,o_orderkey", "--limit", 3)
    assert lines == ["o_orderkey,o_orderpriority", '1,"x,y"', "2,\\N", '3,"x,y"']
    code, lines = run(path, "--ddl", "--sql", "--only-deleted", "--no-complete-insert")
    assert lines[0].startswith("CREATE TABLE") and sum(x.startswith("-- DELETED ctid=(0, ") for x in lines) == sum(1 for k in range(1, 51) if k % 7 == 0 and k % 11)
    assert "public\torders" in "\n".join(run("--datadir", root, "--db-oid", queries.DB, "--list-tables")[1])
    assert any(x.startswith(f"{queries.DB}\ttrue".replace("true", "True")) for x in run(root, "--list-db")[1])
    assert any("orders" in x for x in run(base, "--list-tables-db")[1])
    assert '"table": "orders"' in run(base, "--export-meta")[1][0]
    code, lines = run(path, "--data", "-o", f"{tmp_path}/out/")
    assert code == 0 and lines == [f"{tmp_path}/out/public.orders.csv"] and spark.read.text(lines[0]).count() == len(live)
    assert run(path, "--data", "--fields", "nope")[0] == 1 and "no such columns" in capsys.readouterr().err
    assert run("--data")[0] == 1
