"""Field lists, labels and explicit schemas."""

from __future__ import annotations

# The evidence fields in their order, the dates among them, and their column titles in the register.
EVIDENCE_FIELDS = ("issue", "end", "changed", "issuer", "developer", "builder", "district", "region", "stage", "object")
DATE_FIELDS = ("issue", "end", "changed")
LATEST_FIELDS = ("end", "changed")
CONSENSUS_FIELDS = tuple(f for f in EVIDENCE_FIELDS if f not in LATEST_FIELDS)
TRANSFER_FIELDS = ("stage", "object", "issue", "end", "changed", "issuer", "builder", "region", "district", "developer")
LABELS = {
    "number": "Номер РНС", "stage": "Номер этапа", "object": "Наименование объекта", "issue": "Дата выдачи", "end": "Срок действия", "changed": "Дата последн. измен.",
    "issuer": "Орган выдачи", "builder": "Застройщик", "region": "Субъект РФ", "district": "Муниципальный р-н", "developer": "Разработчик ПД",
}
# Name parts that mark a change or prolongation, lower case.
AMENDMENT_MARKS = ("измен", "продлен", "продлён", "приказ", "распоряжен", "extension", "amendment")
# Beginnings of generated status lines.
SYSTEM_STATUS = ("Не перенесено «", "Не подтверждено «", "В документе не найдено ни одного подтверждённого поля для переноса.", "Связанные изменения содержат разные значения поля «")
FIRST_ROW = 4

WORD = "struct<text:string,left:int,top:int,width:int,height:int,confidence:double>"
LINE = f"struct<page:int,page_width:int,page_height:int,words:array<{WORD}>>"
QUALITY = "map<string,struct<status:string,reason:string,confidence:double>>"
ISSUE = "struct<code:string,field:string,message:string>"
RECORD = (
    "number string, " + ", ".join(f"`{f}` string" for f in EVIDENCE_FIELDS) + ", pdf string, filename string, number_source string, "
    f"field_provenance map<string,string>, warnings array<string>, field_quality {QUALITY}"
)
TRACE = (
    "struct<ocr_trace_version:int,route:string,requested_dpi:int,effective_dpi:int,total_pages:int,processed_pages:int,tesseract_calls:int,tesseract_started:boolean,"
    "fallback_reason:string,timings_ms:struct<page_count:bigint,text_layer:bigint,render:bigint,tesseract:bigint,total:bigint>,dpi:int,pages:int,ocr_calls:int>"
)
ACTION = "struct<type:string,row:int,field:string,status:string>"
