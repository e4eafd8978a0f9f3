"""DuckDB SQL of the queries on sources, sinks and jobs."""

from __future__ import annotations

from .oracles import K, PARTS, S, _iou, _keys, _NEEDS, ORACLES, _sql

_NL = "chr(10)"
PARTS |= {
    "kept_files": "SELECT *, string_split(path, '/')[-2] AS folder FROM files WHERE NOT suffix(path, '_detected_hvac.json') AND file_id % 11 <> 5",
    "sequenced": f"SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY {K}) - 1 AS INT) AS ann_seq FROM fx_annotations",
    "kept_rows": "SELECT r.* FROM resolved r WHERE file_id IN (SELECT file_id FROM kept_files)",
    "kept_names": "SELECT DISTINCT discipline, name FROM fx_categories JOIN kept_files USING (file_id)",
    "tile_named": "SELECT g.*, concat(regexp_replace(regexp_replace(file_name, '\\.png$', ''), '[^A-Za-z0-9_-]', '_', 'g'), '__t', t_idx, '_', x0, '_', y0) AS tile_name FROM grid g",
}
_NEEDS |= {
    "kept_files": ["files"], "sequenced": ["fx_annotations"], "kept_rows": ["resolved", "kept_files"], "kept_names": ["fx_categories", "kept_files"], "tile_named": ["grid"],
}

_TRUTH = f"SELECT {S}, category_id AS label, {K}, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM fx_annotations"


def _greedy(source: str, thresholds: str) -> str:
    """Parts hits(di, threshold), dets and truths of greedy best-first matching."""
    group = f"{S}, label, threshold"
    return f"""dets AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {S}, {K}, t_idx) AS di FROM ({source})),
truths AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {S}, {K}) AS ti FROM ({_TRUTH})),
near AS MATERIALIZED (SELECT {", ".join("d." + c for c in (S + ", label").split(", "))}, d.di, t.ti, d.score, {_iou("d", "t")} AS iou FROM dets d JOIN truths t USING ({S}, label) WHERE {_iou("d", "t")} >= 0.5),
pairs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, di, iou DESC, ti) AS k FROM near JOIN (SELECT unnest({thresholds})::DOUBLE AS threshold) ON iou >= threshold),
run AS (SELECT {group}, 1 AS k, [di] AS ds, [ti] AS ts FROM pairs WHERE k = 1
  UNION ALL SELECT {", ".join("r." + c for c in group.split(", "))}, r.k + 1, CASE WHEN list_contains(r.ds, n.di) OR list_contains(r.ts, n.ti) THEN r.ds ELSE list_append(r.ds, n.di) END,
    CASE WHEN list_contains(r.ds, n.di) OR list_contains(r.ts, n.ti) THEN r.ts ELSE list_append(r.ts, n.ti) END
  FROM run r JOIN pairs n ON {" AND ".join(f"n.{c} = r.{c}" for c in group.split(", "))} AND n.k = r.k + 1),
hits AS MATERIALIZED (SELECT label, threshold, unnest(arg_max(ds, k)) AS di FROM run GROUP BY {group})"""


def _with(needs: str, parts: str, body: str) -> str:
    return f"{_sql(needs, '').rstrip()},\n{parts}\n{body}"


_LADDER = "[" + ", ".join(f"{k / 100}" for k in range(50, 100, 5)) + "]"

FILE_ORACLES: dict[str, str] = {
    "coco_files": _sql("kept_files", "SELECT coco_file, discipline, folder FROM kept_files"),
    "coco_quarantine": "SELECT concat(n_name, '.json') AS file, CASE WHEN n_nationkey % 5 = 2 THEN 'no annotations' ELSE 'no JSON object' END AS reason FROM nation WHERE n_nationkey % 5 < 3",
    "coco_images": _sql("fx_images kept_files", "SELECT coco_file, image_id, file_name, width, height, page FROM fx_images JOIN kept_files USING (file_id)"),
    "coco_categories": _sql("fx_categories kept_files", "SELECT coco_file, CAST(category_id AS BIGINT) AS category_id, name FROM fx_categories JOIN kept_files USING (file_id)"),
    "coco_annotations": _sql("sequenced kept_files", "SELECT coco_file, CAST(ann_seq AS BIGINT) AS ann_seq, image_id, CAST(category_id AS BIGINT) AS category_id, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM sequenced JOIN kept_files USING (file_id)"),
    "pdf_listing": _sql("fx_pdfs", "SELECT string_split(folder, '/')[-1] AS folder, string_split(pdf_path, '/')[-1] AS pdf FROM fx_pdfs"),
    "class_map_read": _sql("class_map", "SELECT * FROM class_map"),
    "class_map_inverted": _sql("class_map", "SELECT * FROM class_map"),
    "class_map_text": _sql(
        "class_map",
        f"""SELECT concat('{{', {_NL}, '  "num_classes": ', count(*), ',', {_NL}, '  "names": [', {_NL}, array_to_string(list(concat('    "', name, '"') ORDER BY class_id), concat(',', {_NL})), {_NL}, '  ],', {_NL},
        '  "name_to_id": {{', {_NL}, array_to_string(list(concat('    "', name, '": ', class_id) ORDER BY class_id), concat(',', {_NL})), {_NL}, '  }}', {_NL}, '}}') AS body FROM class_map""",
    ),
    "dataset_yaml_text": _sql(
        "class_map",
        f"""SELECT concat('path: C:/data/set', {_NL}, 'train: images/train', {_NL}, 'val: images/val', {_NL}, 'nc: ', count(*), {_NL}, 'names:', {_NL},
        array_to_string(list(concat('  ', class_id, ': "', replace(name, ' ', ' '''), '"', {_NL}) ORDER BY class_id), '')) AS body FROM class_map""",
    ),
    "analyze_report": _sql(
        "kept_files kept_rows kept_names",
        f"""SELECT (SELECT count(*) FROM kept_files) AS num_coco_files, count(DISTINCT ({S})) AS num_sheets, count(*) AS total_annotations, (SELECT count(DISTINCT name) FROM kept_names) AS num_classes_combined,
        (SELECT count(*) FROM kept_names WHERE discipline = 'mechanical') AS num_classes_mechanical, (SELECT count(*) FROM kept_names WHERE discipline = 'electrical') AS num_classes_electrical,
        (SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT concat(discipline, '=', count(*)) AS x FROM kept_files GROUP BY discipline)) AS files_per_discipline,
        (SELECT array_to_string(list(name ORDER BY name), ',') FROM kept_names WHERE discipline = 'mechanical') AS mechanical, (SELECT coalesce(array_to_string(list(name ORDER BY name), ','), '') FROM kept_names WHERE discipline = 'electrical') AS electrical,
        (SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT concat(name, '=', count(*)) AS x FROM kept_rows GROUP BY name)) AS instances_per_class FROM kept_rows""",
    ),
    "analyze_markdown": _sql(
        "kept_files kept_rows kept_names",
        f"""SELECT concat('| ', name, ' | ', count(*), ' |') AS line FROM kept_rows WHERE discipline IN ('mechanical', 'electrical') GROUP BY discipline, name
        UNION ALL SELECT concat('| **TOTAL** | **', (SELECT count(*) FROM kept_rows WHERE discipline = d), '** |') FROM (SELECT unnest(['mechanical', 'electrical']) AS d)
        UNION ALL SELECT concat('| of them ', discipline, ' | ', count(*), ' |') FROM kept_files GROUP BY discipline
        UNION ALL SELECT concat('| annotation files | ', count(*), ' |') FROM kept_files
        UNION ALL SELECT concat('| sheets | ', count(DISTINCT ({S})), ' |') FROM kept_rows
        UNION ALL SELECT concat('| boxes | ', count(*), ' |') FROM kept_rows
        UNION ALL SELECT concat('| classes, combined | ', count(DISTINCT name), ' |') FROM kept_names
        UNION ALL SELECT concat('| classes, ', d, ' | ', (SELECT count(*) FROM kept_names WHERE discipline = d), ' |') FROM (SELECT unnest(['mechanical', 'electrical']) AS d)
        UNION ALL SELECT unnest(['# Annotated sheets at a glance', '| What | How many |', '|---|---:|', '## Boxes by class: Mechanical', '## Boxes by class: Electrical', '| Class | Boxes |', '|---|---:|', '| Class | Boxes |', '|---|---:|', '## Box areas in pixels', '', '', '', '', '', '', ''])
        UNION ALL SELECT concat('smallest ', min(a), ', upper median ', max(a) FILTER (r = n // 2), ', largest ', max(a)) FROM (SELECT w * h AS a, row_number() OVER (ORDER BY w * h) - 1 AS r, count(*) OVER () AS n FROM kept_rows)""",
    ),
    "csv_class_counts": _sql("kept_rows", "SELECT name AS class, discipline, CAST(count(*) AS VARCHAR) AS instances FROM kept_rows GROUP BY ALL"),
    "csv_sheet_counts": _sql(
        "kept_rows",
        f"SELECT discipline, coco_file, file_name, CAST(width AS VARCHAR) AS width, CAST(height AS VARCHAR) AS height, CAST(count(*) AS VARCHAR) AS num_objects, CAST(count(DISTINCT name) AS VARCHAR) AS num_classes FROM kept_rows GROUP BY {S}, discipline, coco_file, file_name, kept_rows.width, kept_rows.height",
    ),
    "csv_box_sizes": _sql("kept_rows", "SELECT discipline, name AS class, w::DOUBLE AS w, h::DOUBLE AS h, CAST(w * h AS DOUBLE) AS area, width AS img_w, height AS img_h FROM kept_rows"),
    "prepare_stats": _sql(
        "assigned splits fx_categories kept_files",
        f"""SELECT split, count(DISTINCT ({S}, t_idx)) AS num_tiles, count(*) AS num_boxes FROM assigned JOIN splits USING ({S}) JOIN fx_categories USING (file_id, category_id)
        JOIN (SELECT file_id FROM kept_files WHERE folder <> 'misc') USING (file_id) GROUP BY 1""",
    ),
    "label_text": _sql(
        "labelled splits tile_named empty",
        f"""SELECT split, tile_name, array_to_string(list(format('{{}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', category_id, xc, yc, yw, yh) ORDER BY {K}), {_NL}) AS body
        FROM labelled JOIN splits USING ({S}) JOIN (SELECT {S}, t_idx, tile_name FROM tile_named) USING ({S}, t_idx) GROUP BY 1, 2
        UNION ALL SELECT split, tile_name, '' FROM empty JOIN splits USING ({S}) JOIN (SELECT {S}, t_idx, tile_name FROM tile_named) USING ({S}, t_idx)
        WHERE ('0x' || md5(concat('sample#', sheet_key, '#', t_idx)))::UHUGEINT % 10000 < 1000""",
    ),
    "label_files_read": _sql(
        "labelled tile_named",
        f"""SELECT tile_name, category_id AS class_id, {", ".join(f"CAST(format('{{:.6f}}', {a}) AS DOUBLE) AS {b}" for a, b in (("xc", "xc"), ("yc", "yc"), ("yw", "w"), ("yh", "h")))}
        FROM (SELECT {S}, t_idx, category_id, xc, yc, yw, yh FROM labelled) JOIN (SELECT {S}, t_idx, tile_name FROM tile_named) USING ({S}, t_idx)""",
    ),
    "predict_records": _sql(
        "fx_images fx_files objects sheet_classes",
        rf"""SELECT concat(regexp_replace(regexp_replace(file_name, '\.png$', ''), '[^A-Za-z0-9_-]', '_', 'g'), '_p', CASE WHEN page = 0 THEN 1 ELSE page END) AS sheet_id, regexp_replace(path, '^.*/', '') AS source,
        CASE WHEN page = 0 THEN 1 ELSE page END AS page, width, height, 150 AS dpi, true AS unscaled, coalesce(c.counts, '') AS counts, coalesce(o.objects, '') AS objects
        FROM fx_images i JOIN fx_files USING (file_id) LEFT JOIN (SELECT {S}, string_agg(concat(name, '=', n), ';' ORDER BY name) AS counts FROM sheet_classes GROUP BY ALL) c USING ({S})
        LEFT JOIN (SELECT {S}, string_agg(concat_ws(' ', object_id, type, 'bbox', concat_ws(',', 100 * x1::BIGINT, 100 * y1::BIGINT, 100 * x2::BIGINT, 100 * y2::BIGINT), round(score * 10000)::BIGINT), ';' ORDER BY object_id) AS objects FROM objects GROUP BY ALL) o USING ({S})""",
    ),
    "csv_counts_summary": _sql(
        "fx_images fx_files sheet_classes",
        rf"""SELECT concat(regexp_replace(regexp_replace(file_name, '\.png$', ''), '[^A-Za-z0-9_-]', '_', 'g'), '_p', CASE WHEN page = 0 THEN 1 ELSE page END) AS sheet_id, name AS class, CAST(n AS INT) AS count, regexp_replace(path, '^.*/', '') AS source
        FROM sheet_classes JOIN fx_images USING ({S}) JOIN fx_files USING (file_id)""",
    ),
    "csv_count_accuracy": _sql(
        "sequenced kept_rows",
        f"""SELECT discipline, coco_file, image_id, name AS class, count(*) AS gt, count(*) FILTER (ann_seq % 7 <> 0) AS pred, count(*) FILTER (ann_seq % 7 = 0) AS abs_err
        FROM kept_rows JOIN (SELECT file_id, {K}, ann_seq FROM sequenced) USING (file_id, {K}) GROUP BY {S}, discipline, coco_file, name""",
    ),
    "accuracy_listing": _sql(
        "fx_annotations names_",
        f"""SELECT name, CAST(abs_err AS BIGINT) AS abs_err, gt, 1 - abs_err / gt AS accuracy, CAST(row_number() OVER (ORDER BY name) AS INT) AS place FROM
        (SELECT name, count(*) AS gt, count(*) FILTER (l_partkey % 13 = 0) AS abs_err FROM fx_annotations JOIN names_ ON category_id = class_id GROUP BY 1)""",
    ),
    "greedy_matches": _with("detections fx_annotations", _greedy("SELECT * FROM detections", "[0.5, 0.75]"), "SELECT label, threshold, count(*) AS n FROM hits GROUP BY ALL"),
    "mean_average_precision": _with(
        "predicted fx_annotations",
        _greedy("SELECT * REPLACE (x1 + l_partkey % 9 AS x1, x2 + l_partkey % 9 AS x2) FROM predicted", _LADDER),
        f"""SELECT label, n_truth, round(coalesce(ap50, 0.0::DOUBLE), 6) AS ap50, round(coalesce(ap50_95, 0.0::DOUBLE), 6) AS ap50_95 FROM (SELECT label, count(*) AS n_truth FROM truths GROUP BY 1)
        LEFT JOIN (SELECT label, sum(ap) FILTER (threshold = 0.5) AS ap50, sum(ap) / 10 AS ap50_95 FROM (
          SELECT label, threshold, sum(best * (floor(100 * i / n_truth) - floor(100 * (i - 1) / n_truth) + CASE WHEN i = 1 THEN 1 ELSE 0 END)) / 101 AS ap FROM (
            SELECT label, threshold, tp, i, max(i / n) OVER (PARTITION BY label, threshold ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM (
              SELECT label, threshold, tp, row_number() OVER w AS n, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS i FROM (
                SELECT d.label, e.threshold, d.score, d.di, CASE WHEN h.di IS NULL THEN 0 ELSE 1 END AS tp FROM dets d CROSS JOIN (SELECT unnest({_LADDER})::DOUBLE AS threshold) e LEFT JOIN hits h ON h.di = d.di AND h.threshold = e.threshold)
              WINDOW w AS (PARTITION BY label, threshold ORDER BY score DESC, di)))
          JOIN (SELECT label, count(*) AS n_truth FROM truths GROUP BY 1) USING (label) WHERE tp = 1 GROUP BY 1, 2) GROUP BY 1) USING (label)""",
    ),
}
ORACLES |= FILE_ORACLES
