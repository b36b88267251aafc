import json

from heliograph import __main__ as command
from heliograph.functions import images

from .test_files_and_images import flat


def test_index_and_search(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "RedSword.png").write_bytes(images.png(flat((255, 0, 0))))
    args = command.parser().parse_args(["--library", f"file://{tmp_path}/lib", "--index", f"file:{tmp_path}/p", "--query", "red sword", "--query", "nothing", "--mode", "text", "--json", str(tmp_path / "r.json")])
    command.write_report(command.run(args, spark), args.json)
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["scan"]["changed"] == 1
    first, second = report["searches"]
    assert first["total"] == 1 and first["items"][0]["path"].endswith("RedSword.png") and first["items"][0]["reason"]
    assert second["total"] == 0 and not second["error"]


def test_benchmark(spark):
    args = command.parser().parse_args(["--benchmark", "--vectors", "200", "--dimensions", "16", "--runs", "7"])
    out = command.run(args, spark)["benchmark"]
    assert out["runs"] == 2 and 0 < out["p50_ms"] <= out["p95_ms"] and out["vector_mib"] == 200 * 16 * 4 / (1 << 20)
