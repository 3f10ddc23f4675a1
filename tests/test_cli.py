from palimpsest.cli import Shell


def test_commands(spark, tmp_path):
    f = tmp_path / "products.csv"
    f.write_text("id,name,category,price\nP001,pen,office,1.50\nP002,desk,home,99\nbad,line\nP003,lamp,home,20\n")
    shell = Shell(spark, (tmp_path / "db").as_uri())
    run = lambda c: list(shell.run(c))
    assert run(f"load {f}") == ["3 loaded, 1 errors"]
    assert run("get P002") == ["desk|home|99"] and run("get P9") == ["NOT_FOUND"]
    assert [x.split()[0] for x in run("find home")[1:-1]] == ["P002", "P003"] and run("find home")[-1] == "2 found"
    assert run("last home") == ["lamp|home|20"]
    assert run("put P004 mug home 3") == ["OK"] and run("list")[-1] == "4 found" and run("last home") == ["mug|home|3"]
    assert run("del P003") == ["OK"] and run("del P003") == ["NOT_FOUND"] and run("last home") == ["mug|home|3"]
    assert run("del P004") == ["OK"] and run("last home") == ["NOT_FOUND"]
    assert run("compact") == ["1 runs"] and run("snap")[-1] == "2 found"
    assert run("nonsense") == ["unknown command; try help"] and run("") == [] and "compact" in run("help")[0]
