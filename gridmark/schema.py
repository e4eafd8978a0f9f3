"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

IMAGE = "struct<id:bigint,file_name:string,width:int,height:int,page:int>"
CATEGORY = "struct<id:bigint,name:string>"
ANNOTATION = "struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>"
DOCUMENT = f"images array<{IMAGE}>, categories array<{CATEGORY}>, annotations array<{ANNOTATION}>"
CLASS_MAP = "num_classes int, names array<string>, name_to_id map<string,int>"
DETECTIONS = "sheet_id string, label int, score double, x1 double, y1 double, x2 double, y2 double"
TILE_DETECTIONS = "sheet_id string, t_idx int, label int, score double, x1 double, y1 double, x2 double, y2 double, error string"
LABELS = "split string, tile_name string, class_id int, xc double, yc double, w double, h double"
RASTERS = "pdf_path string, page int, width int, height int, channels int, pixels binary, error string"
