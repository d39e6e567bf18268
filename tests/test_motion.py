import json
import math

import pytest
from pyspark.sql import functions as F

from plotweave.config import A4_PAGE, GANTRY_AREA, StrokeConfig, WorkArea
from plotweave.operators import commands as cmd
from plotweave.operators import mapping, metrics
from plotweave.plans.cli import parser
from plotweave.plans.pipelines import contour_run, stroke_metrics, stroke_run, study_run
from plotweave.segment import FALLBACK, HEURISTIC, NOTE_NO_MODEL, ModelSegmenter, choose, framework_for, segment
from plotweave.sources import firmware, models, sinks
from plotweave.streaming.serial import Handshake, replay, replay_stream, send

COMMANDS = "image_id int, cmd_idx long, x_mm double, y_mm double, mode int"


def test_fit(spark):
    """Published transforms of two images."""
    sizes = spark.createDataFrame([(1, 540, 360), (2, 427, 396)], "image_id int, w int, h int")
    g = {r.image_id: r.transform for r in mapping.transforms(sizes, GANTRY_AREA).collect()}
    assert round(g[1].scale_mm_per_px, 8) == 0.25925926 and round(g[1].y_offset_mm, 8) == 88.33333333 and g[1].x_offset_mm == 5.0
    assert (g[2].scale_mm_per_px, g[2].used_h_mm, g[2].y_offset_mm) == (0.32786885245901637, 129.83606557377047, 70.08196721311477)
    a = {r.image_id: r.transform for r in mapping.transforms(sizes, A4_PAGE).collect()}
    assert round(a[2].scale_mm_per_px, 8) == 0.44496487 and round(a[2].y_offset_mm, 8) == 60.3969555
    p = spark.createDataFrame([(1, 0, 0, 377.0, 16.0)], "image_id int, path_id int, seq int, x double, y double")
    m = mapping.map_points(p, sizes, GANTRY_AREA).first()
    assert (round(m.x_mm, 3), round(m.y_mm, 3)) == (102.741, 92.481)
    assert mapping.map_points(p, sizes, A4_PAGE).first().y_mm > 148
    with pytest.raises(ValueError):
        mapping.transforms(sizes, WorkArea(10, 10, 5))


def test_emit(spark):
    p = spark.createDataFrame([(1, 3, 5, 1.0, 1.0), (1, 0, 0, 2.0, 2.0), (1, 0, 1, 3.0, 3.0)], "image_id int, path_id int, seq int, x_mm double, y_mm double")
    rows = cmd.emit(p).orderBy("cmd_idx").collect()
    assert [(r.cmd_idx, r.x_mm, r.mode) for r in rows] == [(0, 2.0, 0), (1, 3.0, 1), (2, 1.0, 0)]


def test_validate(spark):
    nan = float("nan")
    good = [(0, 0, 0.0, 270.0, 0), (0, 1, 150.0, 0.0, 1)]
    cmd.validate(spark.createDataFrame(good, COMMANDS), 150.0, 270.0)
    for bad, text in (((0, 2, 150.01, 0.0, 1), "Command 2 outside gantry bounds: x=150.01, y=0.00, allowed X=0..150.0, Y=0..270.0"), ((0, 2, nan, 0.0, 1), "Command 2 outside"), ((0, 2, 900.0, 0.0, 2), "Command 2 has invalid mode: 2")):
        with pytest.raises(ValueError) as e:
            cmd.validate(spark.createDataFrame([*good, bad, (0, 3, 999.0, 0.0, 1)], COMMANDS), 150.0, 270.0)
        assert str(e.value).startswith(text)


def test_metrics(spark):
    rows = [(0, 0, 0.0, 0.0, 0), (0, 1, 3.0, 4.0, 1), (0, 2, 3.0, 10.0, 1), (0, 3, 0.0, 10.0, 0)]
    m = metrics.distances(spark.createDataFrame(rows, COMMANDS)).first()
    assert (m.draw_mm, m.travel_mm, m.mode_changes, m.max_y_mm, m.command_count) == (11.0, 3.0, 3, 10.0, 4)
    published = spark.createDataFrame([(446.55737704918033, 272.8957277076888, 8)], "draw_mm double, travel_mm double, mode_changes long")
    t = metrics.times(published, firmware.DEFAULTS).first()
    assert math.isclose(t.draw_s, 32.476900149031295) and math.isclose(t.travel_s, 12.128699009230614) and t.pen_s == 9.8 and math.isclose(t.total_s, 54.40559915826191)
    still = metrics.times(published, firmware.DEFAULTS | {"DRAW_SPEED": 0.0}).first()
    assert still.draw_s is None and math.isclose(still.total_s, 12.128699009230614 + 9.8)


def test_document(spark):
    none = spark.createDataFrame([], COMMANDS).withColumn("image_id", F.col("image_id").cast("string"))
    doc = json.loads(metrics.as_json(metrics.document(spark, "a", none, 0, 150.0, 270.0, dict(firmware.DEFAULTS), "heuristic", None, ["n"], {"margin_mm": 5.0}, {"vertex_count": 0})))
    assert doc["command_bounds_mm"] == {"min_x_mm": None, "max_x_mm": None, "min_y_mm": None, "max_y_mm": None}
    assert doc["bounds_validation_passed"] and doc["bounds_validation_error"] is None and doc["model_path_used"] is None
    assert doc["mode_change_count"] == 0 and list(doc)[:3] == ["schema", "command_count", "stroke_count"] and doc["firmware_constants"]["PEN_UP_ANGLE"] == 95.0


def test_text(spark):
    values = [1.005, 0.125, 2.675, -0.001]
    rows = spark.createDataFrame([(0, i, v, v, 1) for i, v in enumerate(values)], COMMANDS)
    lines = [r.line for r in sinks.command_lines(rows).collect()]
    assert lines == [*sinks.COMMAND_HEAD, "1.00,1.00,1", "0.12,0.12,1", "2.67,2.67,1", "-0.00,-0.00,1"]
    p = spark.createDataFrame([(0, 0, 377.0, 16.0), (0, 1, 370.0, 28.101), (1, 0, 1.0, 2.0)], "path_id int, seq int, x double, y double")
    assert [r.line for r in sinks.point_lines(p, sinks.pixel_head(15.0), "x", "y").collect()] == [sinks.PIXEL_HEAD, "# point_spacing_px = 15.0", "", "# Contour 0", "377.000, 16.000", "370.000, 28.101", "", "# Contour 1", "1.000, 2.000"]
    sizes = spark.createDataFrame([(1, 540, 360)], "image_id int, w int, h int")
    head = sinks.area_head(mapping.transforms(sizes, GANTRY_AREA).first().transform.asDict(), False)
    assert head[4:9] == ["# scale_mm_per_px = 0.25925926", "# x_offset_mm = 5.00000000", "# y_offset_mm = 88.33333333", "# image_size_px = (540, 360)", "# used_size_mm = (140.00000000, 93.33333333)"]


def test_firmware(spark, tmp_path):
    path = tmp_path / "a.ino"
    path.write_text("const int MICROSTEPS = 8;\nconst float MICROSTEPS = -4.5 ;\nconst int OTHER = 1;\nconst float DRAW_SPEED = 1e3;\nconst  int PEN_UP_ANGLE=+90;")
    got = firmware.read_constants(spark, str(path))
    assert got == firmware.DEFAULTS | {"MICROSTEPS": -4.5, "PEN_UP_ANGLE": 90.0}
    gone = firmware.read_constants(spark, str(tmp_path / "none.ino"))
    assert gone == firmware.DEFAULTS | {"firmware_parse_warning": f"Firmware not found: {tmp_path / 'none.ino'}"}


def test_models(spark, tmp_path):
    for name in ("b/x.PTH", "b/.venv/a.pt", "c.txt", ".pt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("m")
    assert models.find_model(spark, str(tmp_path)).endswith("b/x.PTH")
    assert framework_for("m.pb") == "tensorflow" and framework_for("m.ckpt") is None


def picture(spark):
    dark = {(y, x) for y in range(4, 7) for x in range(4, 36)} | {(y, x) for y in range(4, 26) for x in range(4, 7)}
    rows = [("p", 30, 40, y, x, 0 if (y, x) in dark else 255) for y in range(30) for x in range(40)]
    return spark.createDataFrame(rows, "image_id string, h int, w int, y int, x int, gray int")


def test_stroke_run(spark):
    run = stroke_run(picture(spark), StrokeConfig())
    rows = run.commands.orderBy("cmd_idx").collect()
    assert len(rows) >= 2 and rows[0].mode == 0 and rows[1].mode == 1
    assert run.segmentation.mode_used == FALLBACK and run.segmentation.notes[0] == NOTE_NO_MODEL and run.segmentation.model_path is None
    doc = json.loads(metrics.as_json(stroke_metrics(spark, run, "p", dict(firmware.DEFAULTS))))
    assert doc["command_count"] == len(rows) and doc["graph"]["edge_count"] == doc["stroke_count"] and doc["bounds_validation_passed"]


def test_contour_run_and_study(spark):
    run = contour_run(picture(spark))
    assert run.commands.where("mode = 0").count() == 1 and run.stats.first().area > 20
    pts = run.merged.orderBy("seq").collect()
    assert (pts[0].x, pts[0].y) == (pts[-1].x, pts[-1].y)
    assert contour_run(picture(spark), area=A4_PAGE).commands is None
    study = study_run(picture(spark))
    assert study["skeleton"].count() > 0 and study["lines"].count() + study["background"].count() == 1200


def test_model_segmenter(spark):
    stub = lambda path: lambda g: (0.5 - g) * 20
    stub.needs_framework = False
    config = StrokeConfig(segmentation_mode="ml")
    out = segment(picture(spark), config, "m.pt", stub)
    assert out.mode_used == "ml" and out.lines.count() == 3 * 32 + 3 * 19
    broken = lambda path: lambda g: 1 / 0
    broken.needs_framework = False
    out = segment(picture(spark), config, "m.pt", broken)
    assert out.mode_used == FALLBACK and out.model_path == "m.pt" and out.notes[-1] == "Fell back to heuristic segmentation."
    assert segment(picture(spark), StrokeConfig(segmentation_mode="heuristic")).mode_used == HEURISTIC
    with pytest.raises(ValueError):
        choose(StrokeConfig(segmentation_mode="other"), None)
    three = ModelSegmenter(lambda g: __import__("numpy").stack([g, 0 * g, 1 - g]) * 9).segment(picture(spark))
    assert three.lines.count() == 3 * 32 + 3 * 19 and three.nodes.count() == 0


def test_handshake(spark, tmp_path):
    log = ["boot", "ERROR early", "READY", "READY", "OK", "noise", "OK"]
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(log)] + [("e", 0, "READY"), ("e", 1, "ERROR limit"), ("e", 2, "OK")], "device string, seq long, line string")
    got = {(r.device, r.seq): (r.state, r.sent) for r in replay(rows, 2).collect()}
    assert [got["d", i] for i in range(7)] == [("waiting", 0), ("waiting", 0), ("sending", 1), ("sending", 1), ("sending", 2), ("sending", 2), ("done", 2)]
    assert got["e", 2] == ("failed", 1)
    assert Handshake().state == "waiting"
    rows.coalesce(1).write.json(str(tmp_path / "log"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "log"))
    q = replay_stream(stream, 2).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.device, r.seq): (r.state, r.sent) for r in spark.table("replayed").collect()} == got


def test_send():
    replies, out = iter(["x", "READY", "OK", "hm", "OK"]), []
    send(["1.00,2.00,0", "3.00,4.00,1"], lambda: next(replies), out.append)
    assert out == ["1.00,2.00,0\n", "3.00,4.00,1\n", "END\n"]
    replies = iter(["READY", "EMERGENCY stop"])
    with pytest.raises(RuntimeError, match="EMERGENCY stop"):
        send(["a"], lambda: next(replies), out.append)


def test_cli():
    args = parser().parse_args(["--image", "a", "--output-dir", "b"])
    assert (args.threshold, args.work_width_mm, args.work_height_mm, args.margin_mm, args.segmentation_mode) == (127, 150.0, 270.0, 5.0, "auto")


def test_metrics_json_covers_every_image(spark):
    from plotweave.plans import adapters, queries

    d = "/root/testdata/sf0.001"
    docs = {r.image_id: json.loads(r.json) for r in queries.metrics_json(spark, d).collect()}
    own = {}
    for r in adapters.commands(spark, d).orderBy("image_id", "cmd_idx").collect():
        own.setdefault(r.image_id, []).append(r.mode)
    assert set(docs) == set(own) and len(own) == 4
    for i, modes in own.items():
        assert docs[i]["command_count"] == len(modes)
        assert docs[i]["stroke_count"] == sum(m == 1 and (k == 0 or modes[k - 1] != 1) for k, m in enumerate(modes))


def test_numbers_in_text_are_rounded_exactly_and_nulls_stay(spark):
    from plotweave.functions.numbers import three_places, two_places
    from plotweave.operators import commands as cmd

    values = [1000.125, 2.675, 0.125, 1.005, -0.001, None, float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", two_places("v").alias("a"), three_places("v").alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == [None if v is None else f"{v:.2f}" for v in values] and rows[5].b is None
    moves = spark.createDataFrame([("a", 0, 1.0, 1.0, 1), ("a", 1, 1000.125, 2.675, 1), ("a", 2, 1.0, 1.0, 7), ("b", 0, 0.0, 0.0, 0), ("c", 0, None, 1.0, 0), ("d", 4, 1.0, 1.0, None)], "image_id string, cmd_idx long, x_mm double, y_mm double, mode int")
    got = {r.image_id: r.error for r in cmd.first_fault(moves, 150.0, 270.0).collect()}
    assert got == {
        "a": "Command 1 outside gantry bounds: x=1000.12, y=2.67, allowed X=0..150.0, Y=0..270.0",
        "b": None,
        "c": "Command 0 outside gantry bounds: x=None, y=1.00, allowed X=0..150.0, Y=0..270.0",
        "d": "Command 4 has invalid mode: None",
    }


def test_mixed_channel_counts(spark):
    from plotweave.functions.pixels import probability_masks

    rows = [("three", 1, 2, 0, 0, [0.1, 0.2, 0.7]), ("three", 1, 2, 0, 1, [0.3, 0.6, 0.1]), ("one", 1, 2, 0, 0, [0.9]), ("one", 1, 2, 0, 1, [0.2])]
    for part in (rows, rows[::-1]):
        probs = spark.createDataFrame(part, "image_id string, h int, w int, y int, x int, p array<double>").coalesce(1)
        lines, nodes, plain = ({(r.image_id, r.x) for r in t.collect()} for t in probability_masks(probs))
        assert (lines, nodes, plain) == ({("three", 0), ("one", 0)}, {("three", 1)}, {("one", 0)})
