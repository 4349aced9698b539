"""Vocabularies and term lists, as data."""

# --- Fixed values ------------------------------------------------------------------------------
DECISIONS = ["INCLUDE", "EXCLUDE", "MAYBE", "SKIPPED", "ERROR"]
RESULTS = ["PASS", "FAIL", "UNCERTAIN"]
RESULT_ALIASES = {"✅": "PASS", "❌": "FAIL", "⚠️": "UNCERTAIN"}
CODES = ["E1", "E2", "E3", "E4", "E5", "E6", "E7", "E8", "E9", "E10"]
REVIEW_PATTERNS = [
    r"^a\s+systematic\s+review", r"^a\s+meta[\s-]analysis", r"^a\s+narrative\s+review", r"^a\s+scoping\s+review", r"^systematic\s+review\s+and\s+meta[\s-]analysis", r"^review\s+of\s+",
    r"^overview\s+of\s+", r"^state\s+of\s+the\s+art", r"^recent\s+advances\s+in", r"^recent\s+developments\s+in", r"^current\s+perspectives\s+on", r"^an?\s+update\s+on",
]
REVIEW_KEYWORDS = [
    "systematic review", "meta-analysis", "meta analysis", "narrative review", "literature review", "scoping review", "umbrella review", "critical review", "comprehensive review",
    "overview of reviews", "review of reviews", "a review", "an update", "updates on", "current perspectives", "state of the art", "state-of-the-art", "recent advances", "recent developments",
    "recent progress", "a narrative", "a scoping", "a systematic", "a comprehensive", "a critical", "an overview", "an umbrella",
    "综述", "系统综述", "荟萃分析", "meta分析", "文献综述", "范围综述", "伞状综述", "叙述性综述",
]
NON_PROCEDURAL = [
    "knowledge", "cognitive", "written test", "mcq", "multiple-choice", "quiz", "attitude", "satisfaction", "confidence", "self-efficacy",
    "知识", "认知", "笔试", "选择题", "态度", "满意度", "自信", "非程序", "非操作", "理论",
]
INTERNAL_COMPARATOR = [
    "vr内部", "vr 内部", "仅比较vr", "两组均为vr", "同一vr", "另一个vr", "不是非vr对照", "非vr对照缺失", "vr vs vr", "hmd vs desktop", "internal vr", "vr-only",
    "both groups trained on the same", "both groups used the same", "both groups used vr", "both groups received vr training", "both groups practiced on", "两组均使用",
    "junior", "senior", "expert", "novice", "experienced", "experience level", "known-groups", "known groups", "validation study", "proficiency-based test", "messick",
    "效度验证", "经验水平", "专家组", "新手组",
]
TRANSFER = [
    "transfer", "transferred", "迁移", "operating room", "or performance", "real-world", "real world", "clinical performance", "novel task", "follow-up", "follow up", "retention", "delayed", "weeks", "months",
    "真实环境", "真实手术", "临床表现", "随访", "延迟", "保持",
]
NO_TRANSFER = [
    "no transfer", "without transfer", "no retention", "without retention", "无transfer", "无 retention", "没有transfer", "没有 retention", "未报告transfer", "未报告 retention", "无迁移", "无保持",
]
KNOWLEDGE = ["knowledge retention", "knowledge test", "written test", "mcq", "multiple-choice", "quiz", "cognitive", "知识保持", "知识保留", "知识测试", "理论知识", "笔试", "选择题"]
SKILL_TOOLS = [
    "osats", "dops", "grs", "global rating", "direct observation of procedural skills", "proficiency score", "completion time", "objective structured assessment", "operative performance",
    "operative time", "operative duration", "accuracy", "error score", "procedure score", "technical skill", "操作检查表", "操作清单", "手术表现",
]
NON_VR_CONTROL = [
    "control group", "non-training control", "non training control", "no training control", "traditional", "conventional", "standard lectures", "bedside instruction", "usual training",
    "usual curriculum", "box trainer", "physical simulator", "non-vr", "non vr", "对照组", "无训练对照", "传统", "常规", "标准讲座", "床边教学", "非vr",
]
VR_INTERNAL = [
    "vr vs vr", "both groups used vr", "both groups received vr", "both groups trained on", "both groups practiced on", "same vr simulator", "same simulator", "hmd vs desktop", "desktop vs immersive",
    "feedback frequency", "feedback-plus", "augmented feedback", "distributed practice", "massed practice", "same fb circumstances", "同一vr", "vr内部", "两组均使用", "不同反馈", "分散练习", "集中练习",
]
EXPERIENCE = [
    "junior resident", "senior resident", "expert", "novice", "experienced surgeon", "experience level", "known groups", "known-groups", "construct validity", "validation study", "simulator validation",
    "messick", "proficiency-based test", "效度验证", "经验水平", "专家组", "新手组",
]
NO_CONTROL = [
    "no control group", "without a control group", "single group", "single-arm", "single arm", "one-group", "one group", "pre-post", "pre post", "before-after", "within-subject", "within subject",
    "within-participant", "within participant", "无对照组", "单组", "自身前后",
]
SELF_REPORT = [
    "self-confidence", "motivation", "satisfaction", "perceived", "readiness", "questionnaire", "survey", "knowledge test", "knowledge retention", "mcq", "multiple choice", "attitude", "cognitive load",
    "自信", "满意度", "动机", "自评", "感知", "问卷", "知识", "态度",
]
OBJECTIVE = [
    "osats", "dops", "global rating", "checklist", "completion time", "time to completion", "accuracy", "error", "errors", "score", "performance score", "procedure completion", "skill retention",
    "transfer test", "manual dexterity", "technical skill", "操作评分", "完成时间", "准确", "错误", "技能保持", "技能迁移",
]
DELAY = ["retention", "follow-up", "follow up", "month", "week", "transfer test", "3 months", "4 months", "6 months", "12 months", "保持", "随访", "迁移"]
IMMEDIATE = ["immediate post", "immediately after", "same day", "no follow-up", "without follow-up", "即时", "立即", "无随访"]
DESIGN_RISK = ["cross-sectional", "feasibility", "pilot study", "validation study", "construct validity", "correlation", "observational", "横断面", "可行性", "相关性", "观察性"]
CONTROLLED = ["randomized", "randomised", "randomly assigned", "control group", "controlled trial", "quasi-experimental", "对照组", "随机"]
RISK_INTERNAL = ["VR内部", "VR 内部", "仅比较VR", "两组均为VR", "同一VR", "另一个VR", "不是非VR对照", "非VR对照缺失", "VR vs VR", "HMD vs desktop", "both groups", "internal VR", "VR-only"]
RISK_TRANSFER = [
    "transfer", "迁移", "operating room", "OR performance", "real-world", "real world", "clinical performance", "novel task", "follow-up", "follow up",
    "retention", "retested", "maintenance", "delayed", "weeks", "months", "year", "真实环境", "真实手术", "术中表现", "随访", "延迟", "保持",
]
RISK_CONTRADICTION = ["应为INCLUDE", "应为 INCLUDE", "不应被排除", "所有五个维度均PASS", "all five", "should be include", "应排除", "不应纳入"]
RISK_KNOWLEDGE = ["knowledge retention", "knowledge test", "written test", "MCQ", "multiple-choice", "quiz", "cognitive", "知识保持", "知识保留", "知识测试", "理论知识", "笔试", "选择题"]
RISK_CATEGORIES = ["C_INTERNAL_VR_INCLUDED", "EXCLUDE_WITH_TRANSFER_OR_RETENTION_SIGNAL", "KNOWLEDGE_RETENTION_INCLUDED", "EXPLICIT_REASON_CONTRADICTION"]
# ------------------------------------------------------------------------------------------------

#: Rules of an audit: (severity, category, sections, hit terms, absent terms, least hits of the absent terms).
AUDIT_RULES = [
    ("HIGH", "experience_comparator", "CS", EXPERIENCE, "C", NON_VR_CONTROL, 1),
    ("HIGH", "no_control", "CS", NO_CONTROL, "C", NON_VR_CONTROL, 1),
    ("HIGH", "internal_comparator", "C", VR_INTERNAL, "C", NON_VR_CONTROL, 1),
    ("MEDIUM", "self_report", "O", SELF_REPORT, "O", OBJECTIVE, 2),
    ("MEDIUM", "immediate_only", "O", IMMEDIATE, "O", DELAY, 1),
    ("MEDIUM", "design_risk", "S", DESIGN_RISK, "S", CONTROLLED, 1),
]
