"""Detail pages of two registries: cells of HTML tables as evidence, then fields by label.

The parser runs inside Arrow batches and knows tables only: it lays cells out on a grid, so row and
column spans count, and returns evidence of two kinds:

* ``pair``: label cells of a row (``th``, or ``td`` of a label class) with the row's other cells, in order;
* ``column``: in tables whose first row has header cells alone, each later cell under its header.

Everything else is Spark: labels become fields, of a field's pairs the longest value counts (the first
of equal ones), column values follow in order, a line each, and value maps are column expressions.

A label cell that has parts of class ``cn`` is read from the first of them; a label cell without one
counts only where the registry asks for no such part.  Null pages and pages without tables have an
empty map.  A page row is one page; rows of one key are one page.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

_EVIDENCE = "array<struct<kind:string,tab:int,row:int,col:int,label:string,part:string,value:string>>"


_VOID = ("br", "img", "input", "hr", "meta", "link", "wbr", "col")  # elements without an end


class _Cell:
    def __init__(self, tag: str, attrs: dict[str, str | None]):
        number = lambda name: max(1, min(1000, int(attrs[name]))) if (attrs.get(name) or "").isdigit() else 1
        self.header, self.classes = tag == "th", (attrs.get("class") or "").split()
        self.rows, self.columns = number("rowspan"), number("colspan")
        self.pieces: list[str] = []
        self.part: list[str] = []  # of the first piece of class cn

    def text(self, joined: str = "\n") -> str:
        return joined.join(x for x in (p.strip() for p in self.pieces) if x)


class _Grids(HTMLParser):
    """The tables of a page as rows of cells, nested ones on their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[_Cell]]] = []
        self.open: list[tuple[list[list[_Cell]], list[_Cell]]] = []  # tables being read, and their open cells
        self.depth_of_part = 0
        self.title_depth, self.title = 0, []

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        classes = (named.get("class") or "").split()
        if self.title_depth or "project-tit" in classes:
            self.title_depth += tag not in _VOID
        if tag == "table":
            self.open.append(([], []))
            self.tables.append(self.open[-1][0])
        elif self.open and tag == "tr":
            self.open[-1][1].clear()
            self.open[-1][0].append([])
        elif self.open and tag in ("td", "th"):
            rows, cell = self.open[-1]
            if not rows:
                rows.append([])
            cell[:] = [_Cell(tag, named)]
            rows[-1].append(cell[0])
            self.depth_of_part = 0
        elif self.open and self.open[-1][1] and tag == "p" and "cn" in classes and not self.open[-1][1][0].part:
            self.depth_of_part = 1

    def handle_endtag(self, tag):
        if self.title_depth and tag not in _VOID:
            self.title_depth -= 1
        if tag == "p":
            self.depth_of_part = 0
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1][1].clear()
        elif self.open and tag == "table":
            self.open.pop()

    def handle_data(self, data):
        if self.title_depth:
            self.title.append(data)
        for _, cell in self.open:  # text of a nested table belongs to the cell around it, too
            if cell:
                cell[0].pieces.append(data)
        if self.depth_of_part and self.open and self.open[-1][1]:
            self.open[-1][1][0].part.append(data)


def grid(rows: list[list[_Cell]]) -> list[list[_Cell | None]]:
    """Cells by row and column; a cell with spans stands at every place it covers."""
    out: list[list[_Cell | None]] = [[] for _ in rows]

    def put(row: int, column: int, cell: _Cell) -> None:
        out[row] += [None] * (column + 1 - len(out[row]))
        out[row][column] = cell

    for r, cells in enumerate(rows):
        column = 0
        for cell in cells:
            while column < len(out[r]) and out[r][column] is not None:
                column += 1
            for k in range(r, min(len(rows), r + cell.rows)):
                for c in range(column, column + cell.columns):
                    put(k, c, cell)
            column += cell.columns
    return out


def evidence(html: str | None, label_class: str | None) -> tuple[str | None, list[tuple]]:
    """The title and ``(kind, tab, row, col, label, part, value)`` of a page."""
    parser = _Grids()
    parser.feed(html or "")
    parser.close()
    out = []
    for t, rows in enumerate(parser.tables):
        is_label = lambda c: label_class in c.classes if label_class else c.header
        for r, cells in enumerate(rows):
            pairs = zip([c for c in cells if is_label(c)], [c for c in cells if not is_label(c)])
            out += [("pair", t, r, k, a.text(""), "".join(a.part).strip(), b.text()) for k, (a, b) in enumerate(pairs)]
        if len(rows) > 1 and rows[0] and all(c.header for c in rows[0]):
            laid = grid(rows)
            for r, places in enumerate(laid[1:], 1):
                if len(places) == len(laid[0]) and rows[r] and not any(c.header for c in rows[r]):
                    out += [("column", t, r, k, head.text(""), "", cell.text("")) for k, (head, cell) in enumerate(zip(laid[0], places)) if head and cell]
    title = "".join(x.strip() for x in parser.title)
    return title or None, [x for x in out if (x[4] or x[5]) and x[6]]


def page_evidence(pages: DataFrame, key: str, html: str, label_class: str | None = None) -> DataFrame:
    """``(key, page_title, found)`` of every page."""
    kind = dict(pages.dtypes)[key]
    names = [f.split(":")[0] for f in _EVIDENCE[len("array<struct<") : -2].split(",")]
    item = pa.struct([(n, pa.int32() if n in ("tab", "row", "col") else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [evidence(h.as_py(), label_class) for h in batch.column("html")]
            found = [[dict(zip(names, x)) for x in rows] for _, rows in told]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array([t for t, _ in told], pa.string()), pa.array(found, pa.list_(item))], names=["page", "page_title", "found"])

    given = pages.select(F.col(key).alias("page"), F.col(html).cast("string").alias("html"))
    return given.mapInArrow(run, f"page {kind}, page_title string, found {_EVIDENCE}").withColumnRenamed("page", key)


def labelled_fields(found: DataFrame, key: str, labels: Mapping[str, str], joined: str, by_part: bool) -> DataFrame:
    """``(key, page_title, fields)``: values of the known labels, as a map."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    label = F.col("x.part") if by_part else F.col("x.label")
    rows = found.select(key, F.explode("found").alias("x")).select(key, "x.*", F.try_element_at(names, label).alias("field")).filter("field is not null")
    value = F.replace("value", F.lit("\n"), F.lit(joined))
    place = F.struct("tab", "row", "col")
    per = rows.groupBy(key, "field").agg(
        F.max_by(F.when(F.col("kind") == "pair", value), F.when(F.col("kind") == "pair", F.struct(F.length(value), -F.col("tab"), -F.col("row"), -F.col("col")))).alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "column", F.struct(place.alias("place"), "value")))).alias("below"),
    )
    text = F.concat_ws("\n", "longest", F.transform("below", lambda x: x["value"]))
    fields = per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", text)))).alias("fields"))
    titles = found.groupBy(key).agg(F.max("page_title").alias("page_title"))
    return titles.join(fields, key, "left").select(key, "page_title", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"))


#: Labels of a ChiCTR detail page and the fields they stand for.
CHICTR_LABELS = {
    "注册号：": "source_trial_id",
    "最近更新日期：": "last_updated_at_source",
    "注册时间：": "registration_date",
    "注册号状态：": "registration_status",
    "注册题目：": "title",
    "注册题目简写：": "title_acronym",
    "研究课题的正式科学名称：": "scientific_title",
    "研究课题代号(代码)：": "study_subject_id",
    "在二级注册机构或其它机构的注册号：": "secondary_registration_no",
    "申请注册联系人：": "applicant_contact",
    "研究负责人：": "study_leader",
    "申请注册联系人电话：": "applicant_telephone",
    "研究负责人电话：": "study_leader_telephone",
    "申请注册联系人电子邮件：": "applicant_email",
    "研究负责人电子邮件：": "study_leader_email",
    "申请人所在单位：": "applicant_institution",
    "研究负责人所在单位：": "study_leader_institution",
    "申请注册联系人通讯地址：": "applicant_address",
    "研究负责人通讯地址：": "study_leader_address",
    "是否获伦理委员会批准：": "ethics_approved",
    "伦理委员会批件文号：": "ethics_approval_no",
    "批准本研究的伦理委员会名称：": "ethics_committee_name",
    "伦理委员会批准日期：": "ethics_approval_date",
    "研究实施负责（组长）单位：": "responsible_unit",
    "试验主办单位(项目批准或申办者)：": "sponsor",
    "经费或物资来源：": "funding_source",
    "研究疾病：": "conditions",
    "研究疾病代码：": "disease_code",
    "研究类型：": "study_type",
    "研究所处阶段：": "study_phase",
    "研究设计：": "study_design",
    "研究目的：": "study_purpose",
    "纳入标准：": "inclusion_criteria",
    "排除标准：": "exclusion_criteria",
    "研究实施时间：": "study_execute_time",
    "征募观察对象时间：": "recruitment_time",
    "干预措施：": "interventions",
    "研究实施地点：": "locations",
    "测量指标：": "outcomes",
    "征募研究对象情况：": "recruitment_status",
    "年龄范围：": "age_range",
    "性别：": "gender",
    "随机方法（请说明由何人用什么方法产生随机序列）：": "randomization_method",
    "盲法：": "blinding",
    "是否公开试验完成后的统计结果:": "results_public_access",
    "是否共享原始数据：": "ipd_sharing",
    "共享原始数据的方式（说明：请填入公开原始数据日期和方式，如采用网络平台，需填该网络平台名称和网址）：": "ipd_sharing_method",
    "数据采集和管理（说明：数据采集和管理由两部分组成，一为病例记录表(Case": "data_management",
    "数据与安全监察委员会：": "data_safety_monitoring",
}
#: What values of these fields mean; an earlier line wins where a part of a value counts.
CHICTR_VALUES = {
    "registration_status": {"预注册": "Prospective registration", "补注册": "Retrospective registration"},
    "gender": {"男性": "Male", "女性": "Female", "男女均可": "Both"},
    "study_type": {
        "干预性研究": "Interventional",
        "观察性研究": "Observational",
        "诊断试验": "Diagnostic",
        "相关因素研究": "Related factor study",
        "流行病学研究": "Epidemiological research",
        "预防性研究": "Preventive study",
        "病因学研究": "Etiological study",
        "预测研究": "Predictive study",
        "卫生经济学研究": "Health economics research",
        "健康服务研究": "Health services research",
        "基础研究": "Basic research",
        "其他": "Other",
        "其它": "Other",
    },
    "study_phase": {
        "探索性研究/预试验": "Pilot/Exploratory",
        "I期": "Phase 1",
        "I期/II期": "Phase 1/Phase 2",
        "II期": "Phase 2",
        "II期/III期": "Phase 2/Phase 3",
        "III期": "Phase 3",
        "IV期": "Phase 4",
        "其他": "Other",
        "其它": "Other",
        "不适用": "Not Applicable",
    },
    "recruitment_status": {"尚未开始": "Not yet recruiting", "正在进行": "Recruiting", "暂停": "Suspended", "停止": "Stopped early", "完成": "Completed", "未知": "Unknown"},
    "blinding": {"无": "None", "开放标签": "Open label", "单盲": "Single blind", "双盲": "Double blind", "三盲": "Triple blind"},
}
#: Fields whose value must be one of the lines as a whole.
WHOLE_VALUES = ("registration_status", "gender")
#: Labels of a CTR detail page and the fields they stand for.
CTR_LABELS = {
    "登记号": "source_trial_id",
    "相关登记号": "related_ctr",
    "试验方案编号": "protocol_number",
    "试验通俗题目": "title",
    "试验专业题目": "scientific_title",
    "药物名称": "drug_name",
    "药物类型": "drug_type",
    "适应症": "conditions",
    "试验分类": "study_type",
    "试验分期": "study_phase",
    "试验状态": "status",
    "首次公示信息日期": "registration_date",
    "申请人名称": "sponsors",
    "申请人联系人": "sponsor_contact",
    "目标入组人数": "enrollment",
    "已入组人数": "enrolled_count",
    "实际入组总人数": "actual_enrollment",
    "主要终点指标及评价时间": "primary_endpoint",
    "次要终点指标及评价时间": "secondary_endpoints",
    "入选标准": "inclusion_criteria",
    "排除标准": "exclusion_criteria",
    "试验药": "arm_group_interventions",
    "对照药": "control_drug",
    "机构名称": "locations",
    "试验设计": "study_design",
    "设计类型": "design_type",
    "随机化": "randomization",
    "盲法": "blinding",
    "试验范围": "trial_scope",
    "年龄": "age_range",
    "性别": "gender",
    "健康受试者": "healthy_subjects",
    "临床申请受理号": "clinical_application_no",
    "方案最新版本号": "protocol_version",
    "版本日期": "version_date",
    "试验完成日期": "completion_date",
}
CTR_VALUES = {
    "status": {"进行中": "Recruiting", "已完成": "Completed", "尚未招募": "Not yet recruiting", "主动暂停": "Suspended", "暂停": "Suspended", "提前终止": "Terminated", "终止": "Terminated", "招募完成": "Active, not recruiting"},
    "study_phase": {
        "Ⅰ期": "Phase 1",
        "I期": "Phase 1",
        "II期": "Phase 2",
        "Ⅱ期": "Phase 2",
        "Ⅲ期": "Phase 3",
        "III期": "Phase 3",
        "Ⅳ期": "Phase 4",
        "IV期": "Phase 4",
        "I/II期": "Phase 1/Phase 2",
        "Ⅰ/Ⅱ期": "Phase 1/Phase 2",
        "II/III期": "Phase 2/Phase 3",
        "Ⅱ/Ⅲ期": "Phase 2/Phase 3",
        "其它": "Other",
        "其他": "Other",
        "不适用": "Not Applicable",
    },
}
#: Markers of the outcome list of a ChiCTR page, and characters of each kind of criteria that are kept.
OUTCOME, OUTCOME_KIND, PRIMARY, SECONDARY, CRITERIA = "指标中文名：", "指标类型", "主要指标", "次要指标", 2000


def _set(fields: Column, changes: Mapping[str, Column], gone: tuple[str, ...] = ()) -> Column:
    """The map with changed values; nulls are left out."""
    others = F.map_filter(fields, lambda k, _: ~k.isin(*changes, *gone))
    fresh = F.map_filter(F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    return F.map_concat(others, fresh)


def _mapped(value: Column, field: str, values: Mapping[str, Mapping[str, str]]) -> Column:
    lines = values[field]
    return tx.ordered_map(value, dict(lines), [] if field in WHOLE_VALUES else list(lines.items()), value)


def _criteria(at) -> Column:
    part = lambda name, word: F.concat(F.lit(f"{word}: "), F.substring(at(name), 1, CRITERIA))
    both = F.concat_ws("\n", part("inclusion_criteria", "Inclusion"), part("exclusion_criteria", "Exclusion"))
    return F.when(both != "", both)


def outcome_names(text: Column, marker: str, unless: str | None = None) -> Column:
    """Names of the outcomes of one kind, joined."""
    blocks = F.filter(F.transform(F.split(text, OUTCOME), lambda b: F.trim(b)), lambda b: b.contains(marker) & (~b.contains(unless) if unless else F.lit(True)))
    names = F.filter(F.transform(blocks, lambda b: F.trim(F.regexp_extract(b, rf"^([^。]*?)(?:\s*{OUTCOME_KIND}|$)", 1))), lambda n: n != "")
    return F.when(F.size(names) > 0, F.array_join(names, "; "))


def chictr_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, fields)`` of ChiCTR detail pages, in the terms of the record schema."""
    found = labelled_fields(page_evidence(pages, key, html, "left_title"), key, CHICTR_LABELS, " ", by_part=True)
    at = lambda name: F.try_element_at(F.col("fields"), F.lit(name))
    samples = F.transform(F.regexp_extract_all(at("interventions"), F.lit(r"样本量[：:]?\s*(\d+)"), F.lit(1)), lambda n: n.cast("long"))
    changes = {
        "title": F.when(F.length(at("title")) > F.length(F.coalesce("page_title", F.lit(""))), at("title")).otherwise(F.coalesce("page_title", at("title"))),
        **{f: tx.iso_date(at(f)) for f in ("registration_date", "ethics_approval_date", "last_updated_at_source")},
        **{f: _mapped(at(f), f, CHICTR_VALUES) for f in CHICTR_VALUES},
        "eligibility_criteria": _criteria(at),
        "enrollment": F.when(F.size(samples) > 0, F.aggregate(samples, F.lit(0).cast("long"), lambda a, x: a + x)),
        "primary_endpoint": outcome_names(at("outcomes"), PRIMARY),
        "secondary_endpoints": outcome_names(at("outcomes"), SECONDARY, PRIMARY),
    }
    return found.select(key, _set(F.col("fields"), changes, ("inclusion_criteria", "exclusion_criteria")).alias("fields"))


def ctr_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, fields)`` of CTR detail pages, in the terms of the record schema."""
    found = labelled_fields(page_evidence(pages, key, html), key, CTR_LABELS, "\n", by_part=False)
    at = lambda name: F.try_element_at(F.col("fields"), F.lit(name))
    changes = {
        **{f: tx.iso_date(at(f)) for f in ("registration_date", "version_date", "completion_date")},
        **{f: _mapped(at(f), f, CTR_VALUES) for f in CTR_VALUES},
        "enrollment": F.regexp_extract(at("enrollment"), r"(\d+)", 1).try_cast("long"),
        "eligibility_criteria": _criteria(at),
    }
    return found.select(key, _set(F.col("fields"), changes, ("inclusion_criteria", "exclusion_criteria")).alias("fields"))
