"""DuckDB SQL of the registered queries, written apart from the operators."""

from __future__ import annotations

from .fixtures import ANNOTATIONS, CATEGORIES, FILES, IMAGES, PDFS

K = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
S = "file_id, image_id"


def _keys(alias: str) -> str:
    return ", ".join(f"{alias}.{k}" for k in K.split(", "))


_IOU = "(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def _iou(a: str, b: str) -> str:
    inter = _IOU.format(a=a, b=b)
    area = "(({q}.x2 - {q}.x1) * ({q}.y2 - {q}.y1))"
    return f"({inter} / greatest({area.format(q=a)} + {area.format(q=b)} - {inter}, 1e-6))"


def _nms(source: str, by: str) -> str:
    """Greedy suppression as a recursion over ranks that carries the list kept so far."""
    box = f"struct_pack(k := k, x1 := x1, y1 := y1, x2 := x2, y2 := y2)"
    same = " AND ".join(f"n.{c} = r.{c}" for c in by.split(", "))
    return f"""{source}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {K}, t_idx) AS k FROM {source}),
{source}_run AS (SELECT {by}, 1 AS k, [{box}] AS kept FROM {source}_ranked WHERE k = 1
  UNION ALL SELECT {", ".join("r." + c for c in by.split(", "))}, r.k + 1, CASE WHEN len(list_filter(r.kept, lambda q: {_iou("q", "n")} > 0.5)) > 0 THEN r.kept
    ELSE list_append(r.kept, struct_pack(k := n.k, x1 := n.x1, y1 := n.y1, x2 := n.x2, y2 := n.y2)) END
  FROM {source}_run r JOIN {source}_ranked n ON {same} AND n.k = r.k + 1),
{source}_last AS (SELECT {by}, unnest(list_transform(arg_max(kept, k), lambda q: q.k)) AS k FROM {source}_run GROUP BY {by}),
{source}_kept AS (SELECT r.* FROM {source}_ranked r JOIN {source}_last n ON {same} AND n.k = r.k)"""


#: Common table expressions in an order in which each uses earlier ones only.
PARTS = {
    "fx_files": FILES,
    "fx_images": IMAGES,
    "fx_categories": CATEGORIES,
    "fx_annotations": ANNOTATIONS,
    "fx_pdfs": PDFS,
    "files": r"""SELECT *, string_split(path, '/')[-1] AS coco_file,
  CASE WHEN list_contains(string_split(lower(path), '/'), 'mechanical') THEN 'mechanical' WHEN list_contains(string_split(lower(path), '/'), 'electrical') THEN 'electrical'
       WHEN list_contains(string_split(lower(path), '/'), 'plumbing') THEN 'plumbing' ELSE 'unknown' END AS discipline FROM fx_files""",
    "resolved": f"""SELECT a.*, i.file_name, i.width, i.height, c.name, f.path, f.coco_file, f.discipline FROM fx_annotations a JOIN fx_images i USING ({S})
  JOIN fx_categories c USING (file_id, category_id) JOIN files f USING (file_id)""",
    "class_map": "SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS class_id FROM (SELECT DISTINCT name FROM fx_categories)",
    "columns_": f"SELECT *, unnest(list_sort(list_distinct(list_append(range(0, greatest(1, width - 1279), 1024), greatest(0, width - 1280))))) AS x0 FROM fx_images",
    "cells": "SELECT *, unnest(list_sort(list_distinct(list_append(range(0, greatest(1, height - 1279), 1024), greatest(0, height - 1280))))) AS y0 FROM columns_",
    "grid": f"""SELECT {S}, file_name, CAST(row_number() OVER (PARTITION BY {S} ORDER BY x0, y0) - 1 AS INT) AS t_idx, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0,
  CAST(least(x0 + 1280, width) AS INT) AS x1, CAST(least(y0 + 1280, height) AS INT) AS y1 FROM cells""",
    "assigned": f"""SELECT {S}, {_keys("a")}, a.category_id, a.x, a.y, a.w, a.h, g.t_idx, g.x0, g.y0, g.x1, g.y1, greatest(a.x, g.x0) - g.x0 AS cx, greatest(a.y, g.y0) - g.y0 AS cy,
  least(a.x + a.w, g.x1) - greatest(a.x, g.x0) AS cw, least(a.y + a.h, g.y1) - greatest(a.y, g.y0) AS ch
  FROM fx_annotations a JOIN grid g USING ({S}) WHERE a.x < g.x1 AND a.x + a.w > g.x0 AND a.y < g.y1 AND a.y + a.h > g.y0
  AND 10 * (least(a.x + a.w, g.x1) - greatest(a.x, g.x0)) * (least(a.y + a.h, g.y1) - greatest(a.y, g.y0)) >= 3 * a.w * a.h""",
    "labelled": "SELECT *, (cx + cw / 2.0::DOUBLE) / (x1 - x0) AS xc, (cy + ch / 2.0::DOUBLE) / (y1 - y0) AS yc, cw / (x1 - x0) AS yw, ch / (y1 - y0) AS yh FROM assigned",
    "splits": """SELECT i.*, f.coco_file, concat(f.coco_file, '#', i.image_id) AS sheet_key,
  CASE WHEN ('0x' || md5(concat(f.coco_file, '#', i.image_id)))::UHUGEINT % 10000 < 2000 THEN 'val' ELSE 'train' END AS split FROM fx_images i JOIN files f USING (file_id)""",
    "empty": f"SELECT g.* FROM grid g ANTI JOIN assigned a USING ({S}, t_idx)",
    "detections": f"""SELECT {S}, t_idx, {K}, category_id AS label, CAST((l_partkey * 7919 + l_orderkey * 104729 + t_idx * 31) % 10000 AS DOUBLE) / 10000 AS score,
  cx + x0 AS x1, cy + y0 AS y1, cx + x0 + cw AS x2, cy + y0 + ch AS y2 FROM assigned""",
    "numbered_": f"SELECT *, row_number() OVER (ORDER BY {K}, t_idx) AS n_ FROM detections",
    "placed_": "SELECT *, unnest(range(y1::INT // 256, y2::INT // 256 + 1)) AS cy FROM (SELECT *, unnest(range(x1::INT // 256, x2::INT // 256 + 1)) AS cx FROM numbered_)",
    "detections_nms": _nms("detections", "file_id, image_id, label"),
    "seven": "SELECT * FROM detections WHERE label = 7",
    "seven_nms": _nms("seven", "file_id, image_id"),
    "names_": "SELECT concat('Class ', lpad(CAST(range AS VARCHAR), 2, '0')) AS name, CAST(range AS INT) AS class_id FROM range(20)",
    "sheet_classes": f"SELECT {S}, name, count(*) AS n FROM detections_kept JOIN names_ ON label = class_id GROUP BY ALL",
    "objects": f"""SELECT d.*, concat('obj_', lpad(CAST(row_number() OVER (PARTITION BY {S} ORDER BY label, score DESC, {K}, t_idx) - 1 AS VARCHAR), 5, '0')) AS object_id,
  coalesce(name, CAST(label AS VARCHAR)) AS type FROM detections_kept d LEFT JOIN names_ ON label = class_id""",
    "predicted": "SELECT * REPLACE (CASE WHEN l_partkey % 17 = 0 THEN (label + 1) % 25 ELSE label END AS label) FROM detections WHERE l_partkey % 13 <> 0",
    "predicted_nms": _nms("predicted", "file_id, image_id, label"),
    "errors": f"""SELECT {S}, name, CAST(coalesce(g.n, 0) AS BIGINT) AS gt, CAST(coalesce(p.n, 0) AS BIGINT) AS pred, CAST(abs(coalesce(g.n, 0) - coalesce(p.n, 0)) AS BIGINT) AS abs_err
  FROM (SELECT {S}, name, count(*) AS n FROM fx_annotations JOIN names_ ON category_id = class_id GROUP BY ALL) g
  FULL JOIN (SELECT {S}, name, count(*) AS n FROM predicted_kept JOIN names_ ON label = class_id GROUP BY ALL) p USING ({S}, name)""",
    "areas": "SELECT w * h AS area, sqrt(CAST(w * h AS DOUBLE)) AS side FROM resolved",
    "sheets": f"SELECT discipline, coco_file, {S}, file_name, width, height, count(*) AS num_objects, count(DISTINCT name) AS num_classes FROM resolved GROUP BY ALL",
}
_NEEDS = {
    "files": ["fx_files"], "resolved": ["fx_annotations", "fx_images", "fx_categories", "files"], "class_map": ["fx_categories"], "columns_": ["fx_images"], "cells": ["columns_"],
    "grid": ["cells"], "assigned": ["fx_annotations", "grid"], "labelled": ["assigned"], "splits": ["fx_images", "files"], "empty": ["grid", "assigned"], "detections": ["assigned"],
    "detections_nms": ["detections"], "numbered_": ["detections"], "placed_": ["numbered_"], "seven": ["detections"], "seven_nms": ["seven"], "sheet_classes": ["detections_nms", "names_"], "objects": ["detections_nms", "names_"],
    "predicted": ["detections"], "predicted_nms": ["predicted"], "errors": ["fx_annotations", "predicted_nms", "names_"], "areas": ["resolved"], "sheets": ["resolved"],
}


def _sql(needs: str, body: str) -> str:
    wanted: set[str] = set()

    def add(part: str) -> None:
        if part not in wanted:
            for p in _NEEDS.get(part, []):
                add(p)
            wanted.add(part)

    for part in needs.split():
        add(part)
    named = [PARTS[p] if p.endswith("_nms") else f"{p} AS ({PARTS[p]})" for p in PARTS if p in wanted]
    return "WITH RECURSIVE " + ",\n".join(named) + "\n" + body if named else body


_ACC = "CASE WHEN gt <> 0 THEN 1 - abs_err / gt ELSE 'nan'::DOUBLE END AS accuracy"
_RANK = "min(struct_pack(a := lower(path), b := path, c := l_orderkey, d := l_linenumber, e := l_partkey, f := l_suppkey, g := l_extendedprice))"
_HIST = "SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least({last}, floor((v - lo) * {bins} / (hi - lo))) END AS INT) AS bin, count(*) AS n FROM (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (SELECT CAST({v} AS DOUBLE) AS v FROM {t})) GROUP BY ALL"

ORACLES: dict[str, str] = {
    "resolve_annotations": _sql("resolved", f"SELECT {S}, {K}, name, x, y, w, h, discipline FROM resolved"),
    "orphan_annotations": _sql(
        "fx_annotations fx_images fx_categories",
        f"SELECT {S}, {_keys('a')}, category_id, CASE WHEN i.width IS NULL THEN 'image' ELSE 'category' END AS missing FROM fx_annotations a LEFT JOIN fx_images i USING ({S}) LEFT JOIN fx_categories c USING (file_id, category_id) WHERE i.width IS NULL OR c.name IS NULL",
    ),
    "object_files": _sql(
        "fx_files fx_categories",
        "SELECT file_id, path FROM fx_files WHERE NOT suffix(path, '_detected_hvac.json') AND file_id IN (SELECT file_id FROM fx_categories WHERE NOT (file_id % 5 = 0 OR (file_id % 5 = 1 AND category_id % 2 = 0)))",
    ),
    "discipline_files": _sql("files", "SELECT discipline, count(*) AS n FROM files GROUP BY 1"),
    "class_map_combined": _sql("class_map", "SELECT * FROM class_map"),
    "class_map_by_mode": _sql(
        "fx_categories files", "SELECT discipline, name, CAST(row_number() OVER (PARTITION BY discipline ORDER BY name) - 1 AS INT) AS class_id FROM (SELECT DISTINCT discipline, name FROM fx_categories JOIN files USING (file_id))"
    ),
    "mode_annotations": _sql("resolved", "SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS class_id, n FROM (SELECT name, count(*) AS n FROM resolved WHERE discipline = 'mechanical' GROUP BY 1)"),
    "class_counts": _sql("resolved", f"SELECT name, n, CAST(row_number() OVER (ORDER BY n DESC, s) AS INT) AS place FROM (SELECT name, count(*) AS n, {_RANK} AS s FROM resolved GROUP BY 1)"),
    "class_counts_by_discipline": _sql("resolved", f"SELECT discipline, name, n, CAST(row_number() OVER (ORDER BY n DESC, s) AS INT) AS place FROM (SELECT discipline, name, count(*) AS n, {_RANK} AS s FROM resolved GROUP BY 1, 2)"),
    "class_counts_total": _sql("resolved", "SELECT name, count(*) AS n, 0::TINYINT AS is_total FROM resolved GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), 1::TINYINT FROM resolved"),
    "sheet_counts": _sql("sheets", "SELECT * FROM sheets"),
    "report_totals": _sql(
        "files resolved",
        f"""SELECT (SELECT count(*) FROM files) AS num_coco_files, count(DISTINCT ({S})) AS num_sheets, count(*) AS total_annotations, count(DISTINCT name) AS num_classes_combined,
        count(DISTINCT name) FILTER (discipline = 'mechanical') AS num_classes_mechanical, count(DISTINCT name) FILTER (discipline = 'electrical') AS num_classes_electrical FROM resolved""",
    ),
    "box_sizes": _sql("resolved", "SELECT discipline, name, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, CAST(w * h AS DOUBLE) AS area, width AS img_w, height AS img_h FROM resolved"),
    "area_stats": _sql("areas", "SELECT count(*) AS n, min(area) AS min_value, max(area) FILTER (r = all_ // 2) AS median_value, max(area) AS max_value FROM (SELECT area, row_number() OVER (ORDER BY area) - 1 AS r, count(*) OVER () AS all_ FROM areas)"),
    "area_histogram": _sql("areas", _HIST.format(last=59, bins=60, v="side", t="areas")),
    "objects_per_sheet_hist": _sql("sheets", _HIST.format(last=29, bins=30, v="num_objects", t="sheets")),
    "safe_stem": r"SELECT doc_id, substr(regexp_replace(text, '[^\p{L}\p{N}_-]', '_', 'g'), 1, 120) AS safe FROM documents",
    "stem": r"SELECT page_id, regexp_replace(url, '^.*/', '') AS base, regexp_replace(regexp_replace(url, '^.*/', ''), '^(.+)\.[^.]+$', '\1') AS stem FROM pages",
    "tile_grid": _sql("grid", f"SELECT {S}, t_idx, x0, y0, x1, y1 FROM grid"),
    "tile_names": _sql("grid", rf"SELECT {S}, t_idx, concat(regexp_replace(regexp_replace(file_name, '\.png$', ''), '[^A-Za-z0-9_-]', '_', 'g'), '__t', t_idx, '_', x0, '_', y0) AS tile_name FROM grid"),
    "tile_batches": _sql("grid", f"SELECT {S}, t_idx // 16 AS batch, min(t_idx) AS first_tile, max(t_idx) AS last_tile, count(*) AS n FROM grid GROUP BY ALL"),
    "resolve_pdf": _sql(
        "fx_images fx_pdfs",
        f"""SELECT {S}, pdf_path, CASE WHEN page = 0 THEN 1 ELSE page END AS page FROM (SELECT i.{S.split(', ')[0]}, i.image_id, i.page, p.pdf_path,
        row_number() OVER (PARTITION BY i.file_id, i.image_id ORDER BY CASE WHEN contains(regexp_replace(file_name, '\\.png$', ''), regexp_replace(regexp_replace(pdf_path, '^.*/', ''), '\\.pdf$', '')) THEN 0 ELSE 1 END, pdf_path) AS r
        FROM fx_images i LEFT JOIN (SELECT * FROM fx_pdfs WHERE NOT suffix(pdf_path, '_detected_hvac.pdf')) p USING (file_id)) WHERE r = 1""",
    ),
    "page_default": _sql(
        "fx_images",
        "SELECT image_id, CASE WHEN image_id % 7 = 0 OR page = 0 THEN 1 ELSE page END AS page, CASE WHEN image_id % 5 = 0 THEN 0 ELSE width END AS width, image_id % 5 <> 0 AND width <> 0 AND height <> 0 AS resized FROM fx_images",
    ),
    "last_wins_dedupe": _sql(
        "fx_annotations",
        f"SELECT {K} FROM (SELECT {K}, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM fx_annotations) WHERE r = 1",
    ),
    "tile_assign": _sql("assigned", f"SELECT {S}, t_idx, {K}, cx, cy, cw, ch FROM assigned"),
    "yolo_labels": _sql("labelled fx_categories class_map", f"SELECT {S}, t_idx, {_keys('a')}, class_id, xc, yc, yw, yh FROM labelled a JOIN fx_categories USING (file_id, category_id) JOIN class_map USING (name)"),
    "yolo_roundtrip": _sql("assigned", f"SELECT {S}, t_idx, {K}, CAST(cx + x0 AS DOUBLE) AS bx1, CAST(cy + y0 AS DOUBLE) AS by1, CAST(cx + x0 + cw AS DOUBLE) AS bx2, CAST(cy + y0 + ch AS DOUBLE) AS by2 FROM assigned"),
    "sheet_split": _sql("splits", f"SELECT {S}, sheet_key, split FROM splits"),
    "split_summary": _sql("splits", "SELECT split, count(*) AS num_sheets, count(*) / (SELECT count(*) FROM splits) AS rate FROM splits GROUP BY 1"),
    "tile_stats": _sql("assigned splits", f"SELECT split, count(DISTINCT ({S}, t_idx)) AS num_tiles, count(*) AS num_boxes FROM assigned JOIN splits USING ({S}) GROUP BY 1"),
    "empty_tiles": _sql("empty", f"SELECT {S}, t_idx, x0, y0, x1, y1 FROM empty"),
    "empty_tile_sample": _sql("empty splits", f"SELECT {S}, t_idx, sheet_key FROM empty JOIN splits USING ({S}) WHERE ('0x' || md5(concat('sample#', sheet_key, '#', t_idx)))::UHUGEINT % 10000 < 1000"),
    "offset_boxes": _sql("detections", f"SELECT {S}, t_idx, {K}, x1, y1, x2, y2 FROM detections"),
    "iou_pairs": _sql(
        "placed_",
        "SELECT file_id, image_id, label, "
        + ", ".join(f"{s}.{k} AS {k}_{s}" for s in "ab" for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t_idx"))
        + f", {_iou('a', 'b')} AS iou FROM placed_ a JOIN placed_ b USING ({S}, label, cx, cy) WHERE a.n_ < b.n_ AND cx = greatest(a.x1, b.x1)::INT // 256 AND cy = greatest(a.y1, b.y1)::INT // 256 AND {_iou('a', 'b')} > 0.5",
    ),
    "nms_single_class": _sql("seven_nms", f"SELECT {S}, t_idx, {K}, label, score FROM seven_kept"),
    "nms_class_aware": _sql("detections_nms", f"SELECT {S}, t_idx, {K}, label, score FROM detections_kept"),
    "confident_detections": _sql("detections", "SELECT label, count(*) AS n FROM detections WHERE score >= 0.25 GROUP BY 1"),
    "sheet_class_counts": _sql("sheet_classes", "SELECT * FROM sheet_classes"),
    "object_records": _sql("objects", f"SELECT {S}, object_id, type, score, x1, y1, x2, y2 FROM objects"),
    "sheet_records": _sql(
        "fx_images objects sheet_classes",
        rf"""SELECT concat(regexp_replace(regexp_replace(file_name, '\.png$', ''), '[^A-Za-z0-9_-]', '_', 'g'), '_p', CASE WHEN page = 0 THEN 1 ELSE page END) AS sheet_id, {S}, width, height, 150 AS dpi,
        coalesce(counts, '') AS counts, CAST(coalesce(num_objects, 0) AS INT) AS num_objects, coalesce(types, '') AS types FROM fx_images
        LEFT JOIN (SELECT {S}, string_agg(concat(name, '=', n), ';' ORDER BY concat(name, '=', n)) AS counts FROM sheet_classes GROUP BY ALL) USING ({S})
        LEFT JOIN (SELECT {S}, count(*) AS num_objects, string_agg(type, ';' ORDER BY object_id) AS types FROM objects GROUP BY ALL) USING ({S})""",
    ),
    "count_errors": _sql("errors", "SELECT * FROM errors"),
    "count_accuracy": _sql("errors", f"SELECT name, abs_err, gt, {_ACC} FROM (SELECT name, CAST(sum(abs_err) AS BIGINT) AS abs_err, CAST(sum(gt) AS BIGINT) AS gt FROM errors GROUP BY 1)"),
    "count_accuracy_overall": _sql(
        "errors",
        f"SELECT name, abs_err, gt, is_total, {_ACC} FROM (SELECT name, CAST(sum(abs_err) AS BIGINT) AS abs_err, CAST(sum(gt) AS BIGINT) AS gt, 0::TINYINT AS is_total FROM errors GROUP BY 1 UNION ALL SELECT 'OVERALL', CAST(sum(abs_err) AS BIGINT), CAST(sum(gt) AS BIGINT), 1::TINYINT FROM errors)",
    ),
    "legend_rows": _sql(
        "sheet_classes names_",
        "SELECT name, CAST(sum(n) AS BIGINT) AS n, any_value(class_id) % 22 AS colour FROM sheet_classes JOIN names_ USING (name) GROUP BY 1 UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), NULL FROM sheet_classes",
    ),
    "average_precision": _sql(
        "predicted_nms fx_annotations",
        f"""SELECT label, n_truth, CAST(coalesce(m, 0) AS BIGINT) AS n_matched, round(coalesce(s, 0.0::DOUBLE) / n_truth, 6) AS average_precision FROM
        (SELECT category_id AS label, count(*) AS n_truth FROM fx_annotations GROUP BY 1) LEFT JOIN (
        SELECT label, sum(tp) AS m, sum(CASE WHEN tp = 1 THEN best ELSE 0 END) AS s FROM (
          SELECT label, tp, max(p) OVER (PARTITION BY label ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM (
            SELECT label, tp, n, sum(tp) OVER (PARTITION BY label ORDER BY n ROWS UNBOUNDED PRECEDING) / n AS p FROM (
              SELECT d.label, CASE WHEN h.h = 1 THEN 1 ELSE 0 END AS tp, row_number() OVER (PARTITION BY d.label ORDER BY d.score DESC, {", ".join("d." + c for c in S.split(", "))}, {_keys('d')}, d.t_idx) AS n
              FROM predicted_kept d LEFT JOIN (
                SELECT {S}, label, {K}, t_idx, row_number() OVER (PARTITION BY {S}, label, truth ORDER BY score DESC, {K}, t_idx) AS h FROM (
                  SELECT {S}, d.label, {_keys('d')}, d.t_idx, d.score, ({_keys('t')}) AS truth,
                    row_number() OVER (PARTITION BY {S}, d.label, {_keys('d')}, d.t_idx ORDER BY {_iou('d', 't')} DESC, {_keys('t')}) AS r
                  FROM predicted_kept d JOIN (SELECT {S}, category_id AS label, {K}, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM fx_annotations) t USING ({S}, label)
                  WHERE {_iou('d', 't')} >= 0.5) WHERE r = 1) h
              USING ({S}, label, {K}, t_idx)))) GROUP BY label) USING (label)""",
    ),
}
