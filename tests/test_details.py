"""Detail pages of two registries: every label, longest values, header tables with spans."""

import pytest

from palimpsest.sources import details


def cell(label, value, english="x"):
    return f'<td class="left_title"><p class="cn">{label}</p><p class="en">{english}</p></td><td><p class="cn">{value}</p></td>'


CHICTR = f"""<html><div class="project-tit"><b>研究 题目</b><br/> 一</div><div class="project-ms"><table>
<tr class="cn">{cell("注册号：", "ChiCTR2400000001")}{cell("注册时间：", "2024/3/5")}</tr>
<tr>{cell("注册号状态：", "预注册")}{cell("研究类型：", "干预性研究（随机）")}</tr>
<tr>{cell("研究所处阶段：", "II期/III期")}{cell("征募研究对象情况：", "正在进行")}</tr>
<tr>{cell("性别：", "男女均可")}{cell("盲法：", "双盲法")}</tr>
<tr>{cell("研究疾病：", "肺癌")}</tr><tr>{cell("研究疾病：", "非小细胞肺癌 &amp; 其他")}</tr><tr>{cell("研究疾病：", "胃癌")}</tr>
<tr>{cell("纳入标准：", "1. 成人<br>2. 知情同意")}{cell("排除标准：", "妊娠")}</tr>
<tr>{cell("干预措施：", "<table><tr><td>组别：A 样本量：<b>30</b></td></tr><tr><td>样本量 45</td></tr></table>")}</tr>
<tr>{cell("测量指标：", "指标中文名： 总生存 指标类型： 主要指标 指标中文名：无进展生存 指标类型：次要指标 指标中文名：a。b 指标类型：次要指标")}</tr>
<tr><td class="left_title">注册题目：</td><td>没有 cn 部分</td></tr><tr>{cell("未知标签：", "v")}{cell("研究目的：", "")}</tr>
</table></div></html>"""

CTR = """<table><tr><th>登记号</th><td>CTR20240001</td><th>试验状态</th><td>进行中 (招募中)</td></tr>
<tr><th>试验分期</th><td>Ⅱ/Ⅲ期</td><th>首次公示信息日期</th><td>2024-01-09</td></tr>
<tr><th>目标入组人数</th><td>国内: 60 ； 国际: 120</td></tr>
<tr><th>入选标准</th><td><p>1 年龄</p><p>2 体重</p></td><th>排除标准</th><td>过敏</td></tr>
<tr><th>适应症<td>高血压<tr><th>适应症<td>原发性高血压</table>
<table><tr><th>序号</th><th>机构名称</th><th>主要研究者</th></tr>
<tr><td>1</td><td rowspan="2">北京 <b>医院</b></td><td>王</td></tr><tr><td>2</td><td>李</td></tr><tr><td>3</td><td>上海医院</td><td>张</td></tr>
<tr><td colspan="3">合计</td></tr><tr><td>4</td><td>少一格</td></tr></table>"""


def test_chictr_page(spark):
    pages = spark.createDataFrame([(1, CHICTR), (2, None), (3, "<p>no table</p>")], "page_id long, html string")
    got = {r["page_id"]: r["fields"] for r in details.chictr_details(pages, "page_id", "html").collect()}
    f = got[1]
    assert got[2] == {} and got[3] == {}
    assert (f["source_trial_id"], f["registration_date"], f["registration_status"]) == ("ChiCTR2400000001", "2024-03-05", "Prospective registration")
    assert (f["study_type"], f["study_phase"], f["recruitment_status"], f["gender"], f["blinding"]) == ("Interventional", "Phase 2/Phase 3", "Recruiting", "Both", "Double blind")
    assert f["conditions"] == "非小细胞肺癌 & 其他" and f["title"] == "研究 题目一" and f["enrollment"] == "75"
    assert f["eligibility_criteria"] == "Inclusion: 1. 成人 2. 知情同意\nExclusion: 妊娠" and not {"inclusion_criteria", "exclusion_criteria", "study_purpose"} & set(f)
    assert (f["primary_endpoint"], f["secondary_endpoints"]) == ("总生存", "无进展生存")


def test_ctr_page(spark):
    pages = spark.createDataFrame([("a", CTR), ("b", "")], "page_id string, html string")
    got = {r["page_id"]: r["fields"] for r in details.ctr_details(pages, "page_id", "html").collect()}
    f = got["a"]
    assert got["b"] == {}
    assert (f["source_trial_id"], f["status"], f["study_phase"], f["registration_date"], f["enrollment"]) == ("CTR20240001", "Recruiting", "Phase 2/Phase 3", "2024-01-09", "60")
    assert f["conditions"] == "原发性高血压" and f["eligibility_criteria"] == "Inclusion: 1 年龄\n2 体重\nExclusion: 过敏"
    # a cell over two rows counts in both; rows of another width are no data rows
    assert f["locations"] == "北京医院\n北京医院\n上海医院\n合计"


@pytest.mark.parametrize("make,labels", [(details.chictr_details, details.CHICTR_LABELS), (details.ctr_details, details.CTR_LABELS)])
def test_every_label_becomes_its_field(spark, make, labels):
    part = make is details.chictr_details
    rows = "".join(f"<tr>{cell(k, f'値{i}') if part else f'<th>{k}</th><td>値{i}</td>'}</tr>" for i, k in enumerate(labels))
    f = make(spark.createDataFrame([(1, f"<table>{rows}</table>")], "page_id long, html string"), "page_id", "html").first()["fields"]
    computed = {"registration_date", "ethics_approval_date", "last_updated_at_source", "version_date", "completion_date", "inclusion_criteria", "exclusion_criteria"}
    for i, name in enumerate(labels.values()):
        if name in computed:
            assert name not in f
        elif name == "enrollment":
            assert f[name] == str(i)
        else:
            assert f[name] == f"値{i}", name
    assert f["eligibility_criteria"].startswith("Inclusion: 値")


def test_grid_of_spans():
    parser = details._Grids()
    parser.feed("<table><tr><td rowspan=3>a</td><td colspan='2'>b</td></tr><tr><td>c</td><td rowspan=9>d</td></tr><tr><td>e</td></tr></table>")
    assert [[c.text() if c else None for c in row] for row in details.grid(parser.tables[0])] == [["a", "b", "b"], ["a", "c", "d"], ["a", "e", "d"]]
