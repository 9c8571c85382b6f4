"""Word lists, layer orders and weights.

All values here are fixed: results depend on them word for word. Every operator takes them as parameters.
"""

RELATION_WHITELIST = ["CAUSES", "LEADS_TO", "RESULTS_IN", "TRIGGERS", "INDUCES", "ENABLES", "WORSENS", "PREVENTS", "MITIGATES", "INHIBITS"]
LABEL_WHITELIST = ["CAUSES", "LEADS_TO", "RESULTS_IN", "TRIGGERS", "INDUCES", "CONTRIBUTES_TO"]
STRUCTURAL_RELATIONS = ["PART_OF", "NEXT_CHUNK", "HAS_ENTITY", "_Bloom_Perspective_"]
LAYERS = ["ROOT", "CAUSE", "FACTOR", "CONDITION", "ACTION", "MECHANISM", "INTERMEDIATE", "STATE", "EVENT", "OUTCOME", "CONSEQUENCE"]
TRANSITIONS = {
    "ROOT": ["CAUSE", "FACTOR", "CONDITION", "ACTION"],
    "CAUSE": ["MECHANISM", "INTERMEDIATE", "STATE", "EVENT", "OUTCOME"],
    "FACTOR": ["MECHANISM", "STATE", "EVENT", "OUTCOME"],
    "CONDITION": ["STATE", "EVENT", "OUTCOME"],
    "ACTION": ["STATE", "EVENT", "OUTCOME"],
    "MECHANISM": ["INTERMEDIATE", "STATE", "EVENT", "OUTCOME"],
    "INTERMEDIATE": ["INTERMEDIATE", "STATE", "EVENT", "OUTCOME"],
    "STATE": ["STATE", "EVENT", "OUTCOME"],
    "EVENT": ["EVENT", "OUTCOME"],
    "OUTCOME": [],
}
LABEL_TRANSITIONS = {
    "CAUSE": ["INTERMEDIATE", "OUTCOME", "EVENT", "RISK"],
    "INTERMEDIATE": ["INTERMEDIATE", "OUTCOME", "EVENT", "RISK"],
    "CONDITION": ["EVENT", "RISK", "OUTCOME"],
    "RISK": ["EVENT", "OUTCOME"],
    "EVENT": ["OUTCOME", "CONSEQUENCE"],
    "MECHANISM": ["EVENT", "OUTCOME"],
    "FACTOR": ["EVENT", "OUTCOME", "RISK"],
}
TRIGGERS = "导致 引发 引起 从而 因此 使得 由于 致使 造成 诱发 促使 以致 继而 结果 所以 因为 进而 带来 促成 形成".split() + ["cause", "causes", "caused", "lead to", "leads to", "led to", "result in", "results in", "resulted in", "trigger", "triggers", "triggered", "induce", "induces", "induced", "due to", "because of", "thereby", "thus", "hence", "so that"]
STRONG_TRIGGERS = "导致 从而 因此 使得 由于 引起 引发 造成 致使 促使 诱发 诱导 直接原因 间接原因 根本原因 原因为 致 以致".split() + ["resulted in", "leads to", "lead to", "caused", "causes", "because of", "due to", "giving rise to", "resulting in"]
WEAK_TRIGGERS = "影响 关联 相关 伴随 随后 导向 引出 促成".split() + ["then", "after", "followed by", "associated with"]
NEGATION = "未 不 无 并非 否认 并未".split() + ["never", "not", "no evidence", "without"]
UNCERTAINTY = "可能 或许 疑似 尚不明确 推测".split() + ["suspected", "may", "might", "possibly", "uncertain"]
GATE_NEGATIVE = ["尚未证实", "不一定", "未导致", "未引起", "并非由于", "not necessarily", "not cause", "did not cause", "not lead to", "unconfirmed"]
ENABLE_CUES = ["使得", "促成", "enable", "enables", "allow", "allows"]
FORWARD_CUES, REVERSE_CUES = ["导致", "引发", "leads to", "causes"], ["由", "源于", "caused by", "due to"]
BEFORE_CUES, BEFORE_REVERSE_CUES = ["先", "随后", "然后", "after", "then"], ["之前", "此前", "before"]
NODE_FIRST_CUES = ["先", "首先", "起初", "初始", "最初", "initial", "first", "upstream"]
FIRST_CUES = ["诱因", "隐患", "根本原因", "先发", "首发", "首要原因", "前置因素", "root cause"]
UNIT_TRIGGERS = "由于 导致 致使 从而 最终 另查明 经调查 补充说明 因此 所以 进而 造成 引发 使得".split()
TEMPORAL_PATTERN = r"\d{4}年\d{1,2}月\d{1,2}日|\d{1,2}月\d{1,2}日|事故发生后|随后|之后|当日|次日|当班|此前|最终"
ACTOR_PATTERN = r"[\x{4e00}-\x{9fa5}A-Za-z0-9]{2,}(?:公司|单位|部门|项目部|班组|人员|司机|工人|员工|负责人|调查组|管理人员)"
ROLES = [
    ("investigation_conclusion", ["调查认定", "调查结论", "经调查"]),
    ("consequence_description", ["造成", "死亡", "受伤", "损失"]),
    ("disposal_process", ["处置", "救援", "抢险", "整改"]),
    ("cause_supplement", ["另查明", "经调查", "补充说明", "事后发现", "进一步查明"]),
]
MAIN_ROLE = "main_event_narrative"
CANDIDATE_CUES = [("CAUSES", ["导致", "引发", "造成", "致使", "because", "caused", "leads to", "result in"]), ("ENABLES", ["促使", "使得", "加剧", "enable", "enables", "allows"]), ("PRECEDES", ["随后", "之后", "先", "后", "then", "after", "followed by"])]
CONSEQUENCE_WORDS = ["死亡", "遇难", "受伤", "重伤", "轻伤", "伤亡", "直接经济损失"]
LEGACY_TYPES = {"managementaction": "OrganizationAction", "standardclause": "StandardClause", "resourcecondition": "SourceState", "barrier": "Barrier", "humanstate": "SourceState", "hazardsource": "SourceState", "unsafeact": "SourceEvent", "loss": "Consequence"}
CORE_LAYERS = {"OrganizationAction": "S", "SourceState": "C", "Barrier": "C", "Equipment": "C", "Material": "C", "Environment": "C", "Location": "C", "PersonRole": "C", "StandardClause": "O", "SourceEvent": "A", "IntermediateEvent": "E", "HarmEvent": "E", "Consequence": "L", "EvidenceUnit": "E"}
EDGE_WEIGHTS = {"causal": 0.45, "enable": 0.15, "dir": 0.10, "temp": 0.10, "evidence": 0.10, "first": 0.10}
BRANCH_WEIGHTS = {"mean_score": 0.38, "enable": 0.16, "temporal": 0.16, "root_rank": 0.10, "shared": 0.08, "cues": 0.08, "coverage": 0.04}
