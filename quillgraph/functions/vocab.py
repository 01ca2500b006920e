"""Word lists and rules as plain values, and as tables where queries join them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Terms that tell what a passage is about.
TERMS = (
    "角膜塑形镜 低浓度阿托品 眼轴长度 病理性近视 视网膜脱落 调节幅度 LogMAR视力表 全飞秒激光手术 准分子激光手术 RGP镜片 后巩膜加固术 离焦框架镜 视觉训练 "
    "屈光度 远视储备 调节灵敏度 眼压 角膜曲率 调节滞后 近视 远视 散光 弱视 斜视 外斜 内斜 轴性近视 屈光不正 屈光参差 老视 并发性白内障 后巩膜葡萄肿 "
    "视物模糊 眼胀 虹视 眼痛 畏光 流泪 视力下降 豹纹状眼底 视网膜萎缩 脉络膜萎缩 黄斑出血 漆样裂纹 视盘杯盘比(C/D)扩大 眼压升高 瞳孔放大 活动受限 "
    "角膜 晶状体 视网膜 视神经 黄斑区 中心凹 睫状肌 悬韧带 脉络膜 巩膜 前房 房水"
).split()

# Terms that a cut may not leave half of, and parts of them that are words of their own.
CRITICAL_TERMS = TERMS[:9]
VALID_PARTS = "角膜 视网膜 近视 调节 眼轴 手术 激光".split()

# Keywords of each intent, in order of priority of the intents.
INTENT_KEYWORDS = {
    "TREATMENT": "治疗 防控 控制 矫正 改善 缓解 方案 方法 措施 阿托品 OK镜 塑形镜 RGP 眼镜 手术 激光 训练".split(),
    "DIAGNOSIS": "诊断 检查 检测 测量 参数 指标 筛查 发现 眼压 角膜曲率 屈光度 眼轴长度 视力".split(),
    "MECHANISM": "机制 原理 原因 导致 引起 形成 发生 发展 病理 生理 眼轴 屈光 调节 集合 融像".split(),
    "SYMPTOM": "症状 表现 体征 症状体征 视物模糊 视力下降 看不清 疲劳 不适 感觉 现象".split(),
    "PREVENTION": "预防 保健 保护 注意 避免 减少 降低 增强 户外活动 用眼卫生 休息".split(),
    "COMPLICATION": "并发症 副作用 风险 危害 影响 不良 后遗症 视网膜脱落 青光眼 白内障".split(),
    "RISK_FACTOR": "风险因素 诱因 危险 因素 影响 相关 关联 遗传 环境 习惯".split(),
}
# Words that raise an intent once, and by how much.
INTENT_BOOSTS = {
    "TREATMENT": (2, "阿托品 OK镜 塑形镜 RGP 眼镜 手术 激光".split()),
    "DIAGNOSIS": (2, "眼压 角膜曲率 屈光度 眼轴长度 视力".split()),
    "MECHANISM": (1, "眼轴 屈光 调节 集合 融像".split()),
    "COMPLICATION": (2, "视网膜脱落 青光眼 白内障".split()),
}
# Keywords of the simple classifier, in its order of intents.
FALLBACK_KEYWORDS = {
    "COMPLICATION": "副作用 不良反应 并发症 不良后果 风险 危害".split(),
    "TREATMENT": "治疗 防控 控制 矫正 改善 缓解 方案 方法".split(),
    "MECHANISM": "机制 原理 原因 导致 引起 形成 发生 发展".split(),
    "SYMPTOM": "症状 表现 体征 视物模糊 视力下降 疲劳".split(),
    "DIAGNOSIS": "诊断 检查 检测 测量 参数 指标 筛查".split(),
    "PREVENTION": "预防 保健 保护 注意 避免 减少".split(),
    "RISK_FACTOR": "风险因素 诱因 危险 因素 相关 关联".split(),
}
# Relations of each intent, by what they are used for.
RELATIONS = {
    "paths": {
        "TREATMENT": "治疗 防控 矫正 改善 缓解".split(), "MECHANISM": "导致 引起 形成 发生 表现为".split(), "SYMPTOM": "表现为 症状 体征".split(), "DIAGNOSIS": "检查 测量 诊断".split(),
        "PREVENTION": "预防 保健".split(), "COMPLICATION": "并发症 导致 引起 副作用".split(), "RISK_FACTOR": "风险因素 诱因 相关".split(),
    },
    "neighbours": {
        "TREATMENT": "治疗 防控 矫正 改善 缓解 治愈 控制".split(), "MECHANISM": "导致 引起 形成 发生 产生 诱发".split(), "SYMPTOM": "表现为 症状 体征 显示 出现".split(),
        "DIAGNOSIS": "检查 测量 诊断 检测 筛查 评估".split(), "PREVENTION": "预防 保健 保护 避免 降低".split(), "COMPLICATION": "并发症 副作用 导致 引起 风险".split(),
        "RISK_FACTOR": "风险因素 诱因 相关 影响 关联".split(),
    },
}
# Words added to a query of an intent, and words that keep it as it is.
REWRITES = {
    "TREATMENT": ("治疗方案", "临床效果"), "MECHANISM": ("发病机制", "原理"), "SYMPTOM": ("症状", "表现"), "DIAGNOSIS": ("诊断方法", "检查"), "PREVENTION": ("预防措施", "预防方法"),
    "COMPLICATION": ("并发症", "副作用"), "RISK_FACTOR": ("危险因素", "诱因"),
}
COMPARISONS = "比较 区别 差异 对比 差别 不同".split()

# Keywords that stand for entities in a query.
ENTITY_KEYWORDS = (
    "近视 远视 散光 弱视 斜视 病理性近视 轴性近视 屈光不正 屈光参差 白内障 青光眼 沙眼 OK镜 角膜塑形镜 低浓度阿托品 阿托品 RGP镜片 后巩膜加固术 准分子激光手术 LASIK "
    "全飞秒激光手术 SMILE 眼内接触镜植入 ICL 视网膜 角膜 晶状体 视神经 黄斑区 脉络膜 巩膜 眼轴 前房 房水 悬韧带 视物模糊 视力下降 豹纹状眼底 视网膜萎缩 脉络膜萎缩 "
    "眼轴长度 屈光度 调节幅度 调节灵敏度 眼压 角膜曲率 远视储备 并发症 调节 集合 融像"
).split()

# Relations whose long targets are properties, and the property each becomes (description if not named).
SINKING = "定义 definition 描述 description 特征 feature 表现 manifestation 表现为 含义 meaning explanation 解释".split()
SUNK_AS = {"定义": "definition", "definition": "definition", "含义": "definition", "解释": "definition", "表现": "manifestation", "表现为": "manifestation", "manifestation": "manifestation", "特征": "feature", "feature": "feature"}

# Classes of the vocabulary.
CLASSES = "疾病 症状体征 部位 检查参数 治疗防控".split()


def intent_rules(spark: SparkSession) -> DataFrame:
    """(intent, priority, keyword, boost): the keyword table; boost is that of a word which raises its intent."""
    rows = []
    for priority, (intent, words) in enumerate(INTENT_KEYWORDS.items(), 1):
        boost, raising = INTENT_BOOSTS.get(intent, (0, []))
        rows += [(intent, priority, w, True, boost if w in raising else 0) for w in words]
        rows += [(intent, priority, w, False, boost) for w in raising if w not in words]
    return spark.createDataFrame(rows, "intent string, priority int, keyword string, counts boolean, boost int")
