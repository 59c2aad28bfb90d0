"""Explicit schemas of everything that is read; nothing is inferred."""

from __future__ import annotations

from .functions.dims import DIMENSION
from .functions.numbers import VALUE

META = "struct<standard:string,source_type:string,clutter:string,has_gdt:boolean,difficulty:string>"
REGION = f"struct<id:int,class:string,bbox:array<double>,text:string,cells:array<string>,parsed:{DIMENSION}>"
FEATURE = f"struct<value:{VALUE},text:string,bbox:array<double>>"

# one JSON document per image, as stored
ANNOTATION_JSON = (
    f"image string, width int, height int, status string, meta {META}, "
    f"regions array<{REGION}>, features map<string,variant>"
)
COCO_JSON = (
    "categories array<struct<id:int,name:string>>, "
    "images array<struct<id:bigint,file_name:string,width:int,height:int,extra:struct<name:string>>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int>>"
)
DETECTION = "struct<id:int,class:string,confidence:double,bbox:array<double>,text:string>"
OCR_JSON = f"image string, task string, ocr_model string, mode string, detections array<{DETECTION}>"
USAGE = "struct<latency_s:double,input_tokens:bigint,output_tokens:bigint,total_tokens:bigint,cost_usd:double>"
VLM_JSON = (
    f"image string, task string, mode string, vlm_model string, extracted variant, usage {USAGE}, "
    "context struct<ocr_model:string,crop_detector:string>"
)
RUNS = (
    "id string, stage string, task string, model string, metrics map<string,double>, "
    "extra map<string,string>, timestamp timestamp"
)
DETECTIONS = (
    "run_id string, image string, class string, pred_idx int, x1 double, y1 double, x2 double, y2 double, score double"
)

# The fields of a drawing, in prompt order.
FEATURE_SCHEMA = [
    {"name": "length_before_bend", "type": "number", "unit": "mm", "description": "Overall length of the part in the flat pattern (before bending)"},
    {"name": "length_after_bend", "type": "number", "unit": "mm", "description": "Overall length of the formed part (after bending)"},
    {"name": "width_before_bend", "type": "number", "unit": "mm", "description": "Overall width of the part in the flat pattern (before bending)"},
    {"name": "width_after_bend", "type": "number", "unit": "mm", "description": "Overall width of the formed part (after bending)"},
    {"name": "height_before_bend", "type": "number", "unit": "mm", "description": "Overall height of the part in the flat pattern (before bending)"},
    {"name": "height_after_bend", "type": "number", "unit": "mm", "description": "Overall height of the formed part (after bending)"},
    {"name": "bends_count", "type": "integer", "unit": None, "description": "Number of bends in the part"},
    {"name": "circular_holes_count", "type": "integer", "unit": None, "description": "Number of circular holes in the part"},
    {"name": "noncircular_holes_count", "type": "integer", "unit": None, "description": "Number of non-circular holes (slots, rectangular or shaped cut-outs)"},
    {"name": "circular_hole_diameters", "type": "list", "unit": "mm", "description": "Diameters of the circular holes, one value per hole (e.g. [5, 8, 8])"},
    {"name": "cut_perimeter", "type": "number", "unit": "mm", "description": "Total cut perimeter length"},
    {"name": "material", "type": "string", "unit": None, "description": "Material specification (e.g. Steel 1045, Al 6061)"},
    {"name": "standard", "type": "string", "unit": None, "description": "Referenced engineering standard (e.g. ISO 2768, ASME Y14.5)"},
    {"name": "part_name", "type": "string", "unit": None, "description": "Part name / title from the drawing's title block"},
    {"name": "drawing_number", "type": "string", "unit": None, "description": "Drawing number / identifier from the title block"},
]
# The metric a stage's best run is chosen by.
STAGE_METRIC = {"detection": "map50", "ocr": "coverage", "vlm": "fill_rate"}
CATEGORIES = {"dimension": 1, "table": 2}
