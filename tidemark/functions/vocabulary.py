"""Terms of the news rules.

Fixed values: all lists and numbers of this module are those of the rules; results depend on each of them and on their order.
"""

from __future__ import annotations

#: Categories in order, with their base score and terms.
CATEGORIES = (
    ("兒少保護", 4, "兒虐 虐童 兒少保護 兒童權利 性剝削 托嬰 保母 兒少安置 兒童安置 少年安置 收出養 寄養 兒少 兒童 少年"),
    ("家暴與性暴力", 4, "家暴 家庭暴力 性侵 性暴力 性騷擾 跟蹤騷擾 保護令 性影像"),
    ("心理健康與成癮", 3, "心理健康 精神衛生 精神疾病 自殺 自傷 成癮 毒品 酒癮"),
    ("長照與高齡", 3, "長照 高齡 老人 失智 照顧者 住宿機構 居家照顧"),
    ("社會救助與居住", 3, "社會救助 低收入 中低收入 貧窮 弱勢家庭 街友 無家者 租屋 居住權 住宅"),
    ("身障與人權", 3, "身心障礙 身障 無障礙 CRPD 人權公約 合理調整"),
    ("移工與新住民", 3, "移工 外籍勞工 新住民 移民 難民 人口販運"),
    ("勞動與社會保障", 3, "勞保 就業保險 職業災害 職災 育嬰留職停薪 性別平等工作法 就業歧視 職場霸凌 勞工權益 失業給付 就業服務 身障就業 庇護工場 最低工資 勞退"),
    ("教育與學生輔導", 3, "學生輔導 校園霸凌 中途輟學 中輟 特殊教育 身心障礙學生 校園性別事件 學校社工 青少年輔導 弱勢學生"),
    ("司法保護與修復式司法", 4, "犯罪被害人 被害人保護 犯罪被害人權益保障 修復式司法 更生保護 保護管束 榮譽觀護人 觀護人 社區矯治 社區處遇 社會勞動 戒癮處遇 被害補償金"),
    ("少年司法與犯罪防治", 3, "少年事件 少年司法 少年犯罪 少年觀護 觸法少年"),
    ("性別與家庭政策", 2, "性別平等 婦女 育兒 托育 家庭政策 少子化 生育 婚姻平權"),
    ("災害與社區工作", 2, "災害救助 災民 安置中心 撤離 避難 社區韌性 震災 颱風 洪水 土石流"),
    ("社工專業與社福制度", 4, "社工 社會工作 社福 社會福利 社安網 保護服務 責任通報 通報制度 脆弱家庭"),
)
POLICY = "修法 修正 政策 制度 改革 通報 補助 津貼 權益 福利 保護 安置 服務量能 人力不足 監察 行政院 衛福部 條例 施行細則 法規 草案 預告 指引 要點 給付 保險 保障".split()
INTERNATIONAL_CORE = "兒童權利 社會福利 社會政策 移民 難民 人權 心理健康 高齡 家暴 性暴力 災害 貧窮 身心障礙".split()
LOW_VALUE = (
    "好禮 選購 愛心捐贈 公益捐贈 徵求 招標 採購 徵件 動漫菸品 疫苗 流感 登革熱 牙醫醫療站 競賽 招生 徵才 表揚 書展 文化幣 科普 論壇 新書發表 急診 熱傷害 "
    "頒獎 典禮 成果發表 模擬投票 築夢 博覽會 開講 接見 訪問團 投資環境 評選 涉詐 詐領 起訴 演練 防衛韌性 課桌椅 揭牌 聯展 音樂會 媒體報導 澄清 駁斥 與事實不符"
).split()
#: Signs of an event, in titles: changes of law, weak ones, reports, rulings, grave events; and of mere procedure.
STRUCTURAL = "修法 修正 通過 核定 生效 施行 上路 新制 新法 草案 預告 調升 調降 提高 降低 加碼 新增 增訂 放寬 改革 訂定 廢止 取消 整併 納入 開放申請 補助提高 給付調整".split()
STRUCTURAL_WEAK = "擴大 啟動 強化 精進".split()
REPORTS = "調查結果 統計結果 公布調查 發布調查 公布統計 發布統計 調查顯示 統計顯示 報告指出 年度報告 白皮書".split()
JUDICIAL = "判決 裁定 釋憲 憲法法庭".split()
SERIOUS = "兒虐 虐童 虐嬰 虐死 保母虐 兒童遭虐 幼童遭虐 家庭暴力 家暴 性侵 性暴力 人口販運 校園霸凌 重大職災 犯罪被害人 災害救助 大規模撤離".split()
PROCEDURAL = "敬請支持 請支持 歡迎 踴躍 申請倒數 把握時間 提醒 宣導 競賽 徵件 徵才 參訪 拜會 揭牌 典禮 成果發表 研習 課程 工作坊 論壇 說明會 專案成果".split()
#: Signs of an event in the press: roles, persons at risk, harm, the system around them.
SOCIAL_WORK = "社工 社會工作".split()
ROLES = "保母 托嬰 托育 兒少安置 安置機構 社福機構 長照機構 養護機構 安養機構 身障機構 街友 無家者 人口販運".split()
VULNERABLE = "兒童 兒少 少年 幼童 嬰兒 長者 老人 身障 身心障礙 移工 新住民 學生".split()
HARM = "虐 侵占 詐 性侵 剝削 疏失 失職 死亡 致死 停業 裁罰 起訴 羈押 判刑 違法 通報 霸凌 自殺 自傷 毒品 成癮 攻擊".split()
SYSTEM = "社會局 社工 社會工作 社福 責任通報 通報 訪視 安置 機構 照顧 保護 輔導 福利 社會安全網 跨網絡 教育局".split()
PROFESSIONAL = "專業倫理 專業責任 個案管理 責任通報 保護服務 訪視疏失 機構內控 內控檢討 制度檢討 機構責信 督導制度 專業懲戒 社工師公會 兒少保護 長者保護 老人保護 社會安全網 跨網絡 服務流程檢討".split()
SCHOOL, SCHOOL_HARM = "校園 學生".split(), "毒品 霸凌 自殺 自傷 性侵 性騷擾".split()
#: The same signs in English.
EN_STRUCTURAL = ("guidance", "guideline", "law", "legislation", "reform", "policy change", "new policy", "adopted", "approved", "enters into force", "takes effect", "standards", "recommendation", "recommendations", "calls for")
EN_REPORTS = ("report finds", "report shows", "new report", "data show", "survey finds", "estimates")
EN_SERIOUS = ("child abuse", "domestic violence", "sexual violence", "human trafficking", "disaster displacement", "refugee crisis")
EN_NOISE = ("orientation course", "course", "workshop", "conference", "webinar", "training", "project improves", "project concludes", "project supports")
EN_POLICY = ("policy", "policies", "law", "legislation", "reform", "guidance", "guideline", "standards", "strategy", "programme", "program", "services", "rights", "protection", "benefit", "benefits", "social protection", "framework", "action plan", "recommendation", "recommendations")
#: Terms with rules of their own.
CHILD_WEAK = "兒少 兒童 少年 保母".split()
CHILD_STRONG = "兒少保護 兒虐 虐童 兒童權利 性剝削 托嬰 兒少安置 兒童安置 少年安置 收出養 寄養 責任通報 兒童及少年福利與權益保障法 兒童權利公約 兒少生活狀況 生活狀況調查".split()
FAMILY_STRONG = "托育 育兒 少子化 家庭政策 性別平等 育嬰留職停薪".split()
DISASTER_STRONG = "災害救助 災民 安置 撤離 避難 社區韌性".split()
#: Concepts with their category, tag and aliases.
CONCEPTS = (
    ("child_protection", "兒少保護", "兒少保護", ("兒少保護", "兒童保護", "兒虐", "虐童", "child protection", "child safeguarding", "protect children")),
    ("child_rights", "兒少保護", "兒童權利", ("兒童權利", "兒童權利公約", "crc", "child rights", "rights of the child", "convention on the rights of the child")),
    ("mental_health", "心理健康與成癮", "心理健康", ("心理健康", "精神衛生", "mental health", "psychosocial support", "psychosocial wellbeing", "psychosocial well-being")),
    ("suicide_prevention", "心理健康與成癮", "自殺防治", ("自殺防治", "自殺預防", "suicide prevention", "prevent suicide")),
    ("disability_rights", "身障與人權", "身障權利", ("身心障礙", "障礙者權利", "crpd", "disability rights", "persons with disabilities", "people with disabilities")),
    ("refugees_migration", "移工與新住民", "移民與難民", ("移民", "難民", "移工", "refugee", "refugees", "migrant", "migrants", "migration", "asylum seeker", "asylum seekers")),
    ("gender_violence", "家暴與性暴力", "性別暴力", ("家庭暴力", "家暴", "性暴力", "性侵", "gender-based violence", "gender based violence", "domestic violence", "sexual violence")),
    ("social_protection", "社會救助與居住", "社會保障", ("社會救助", "貧窮", "social protection", "social assistance", "income support", "poverty reduction")),
    ("labor_rights", "勞動與社會保障", "勞動權益", ("勞工權益", "勞動權益", "社會保險", "labour rights", "labor rights", "social security", "employment protection", "occupational safety")),
    ("ageing_care", "長照與高齡", "高齡與照顧", ("長照", "高齡", "失智", "long-term care", "long term care", "older persons", "older people", "ageing", "aging", "dementia")),
    ("disaster_displacement", "災害與社區工作", "災害與安置", ("災害救助", "災民", "撤離", "disaster displacement", "disaster response", "emergency shelter", "humanitarian emergency")),
    ("juvenile_justice", "少年司法與犯罪防治", "少年司法", ("少年司法", "觸法少年", "juvenile justice", "youth justice", "children in conflict with the law")),
    ("restorative_justice", "司法保護與修復式司法", "修復式司法", ("修復式司法", "犯罪被害人", "被害人保護", "restorative justice", "victim support", "victim protection", "crime victims")),
    ("family_policy", "性別與家庭政策", "家庭政策", ("托育", "育兒", "家庭政策", "少子化", "childcare", "child care", "family policy", "parental leave", "care leave")),
    ("student_support", "教育與學生輔導", "學生輔導", ("學生輔導", "校園霸凌", "中輟", "student support", "school counselling", "school counseling", "school bullying", "dropout prevention")),
)
AGENCIES = (
    ("who", ("who", "world health organization", "世界衛生組織")),
    ("unicef", ("unicef", "united nations children's fund", "聯合國兒童基金會")),
    ("ilo", ("ilo", "international labour organization", "international labor organization", "國際勞工組織")),
    ("un", ("united nations", "un news", "聯合國")),
    ("unhcr", ("unhcr", "un refugee agency", "united nations high commissioner for refugees", "聯合國難民署")),
)
#: Concepts of past exams with their label, whether they need a shared law, and aliases.
HISTORY = (
    ("minimum_wage", "最低／基本工資", False, ("最低工資", "基本工資", "minimum wage")),
    ("welfare_survey", "福利需求調查", True, ("生活狀況調查", "需求調查", "身心發展調查", "調查統計機制")),
    ("childcare", "托育", False, ("托育", "托嬰", "居家式托育", "居家托育", "childcare", "child care")),
    ("long_term_care", "長期照顧", False, ("長期照顧", "長照", "long-term care", "long term care")),
    ("residential_support", "住宿式照顧", False, ("住宿式服務機構", "住宿機構", "住宿費", "住宿補助")),
    ("labor_insurance", "勞工保險", False, ("勞保", "勞工保險", "labor insurance")),
    ("retirement_pension", "退休年金", False, ("延後退休", "老年年金", "勞保年金", "退休年金", "retirement pension", "old-age pension")),
    ("disability_employment", "身障就業", False, ("身障就業", "庇護工場", "定額進用", "職業重建")),
    ("elderly_living_alone", "獨居高齡者", False, ("獨居老人", "獨居長者", "獨老")),
)
#: Concepts that link an event with a question by themselves.
STANDALONE = "social_protection refugees_migration restorative_justice juvenile_justice mental_health suicide_prevention gender_violence disaster_displacement".split()
WEAK_TAGS = "政策 制度 福利 保護 權益 保障 服務 補助 津貼 法規 條例 兒童 少年 老人 高齡 社工 社會工作 身心障礙 身障 長照 移工 新住民 移民 難民 衛福部 衛生福利部 行政院 內政部 勞動部 教育部 法務部 考試院 國民健康署".split()
KNOWN_LAWS = (
    "兒童及少年福利與權益保障法 老人福利法 身心障礙者權益保障法 家庭暴力防治法 社會救助法 社會工作師法 長期照顧服務法 兒童及少年性剝削防制條例 性別平等工作法 "
    "性侵害犯罪防治法 特殊境遇家庭扶助條例 國民年金法 身心障礙者權利公約 志願服務法 兒童及少年未來教育與發展帳戶條例 精神衛生法 兒童權利公約 公益勸募條例 "
    "身心障礙者權利公約施行法 病人自主權利法 就業保險法 兒童權利公約施行法 全民健康保險法 學生輔導法 民法 消除對婦女一切形式歧視公約施行法 少年事件處理法 "
    "性騷擾防治法 毒品危害防制條例 長期照顧服務機構法人條例 人口販運防制法 住宅法 性別平等教育法 社會福利基本法 跟蹤騷擾防制法 犯罪被害人權益保障法"
).split()
#: Levels of policy, essay and question value by terms or patterns.
POLICY_LEVELS = (
    "修法 修正 施行細則 正式上路 核定 公告實施 補助調增 每月補助 追溯自 辦法修正 制度上路 正式實施 院會通過 通過修正".split(),
    "政策 制度 改革 研議 檢討 座談 調查 規劃 方案 支持措施 權益保障 服務量能".split(),
    "宣導 活動 記者會 倡議 響應 節日 月口號 好禮 選購 徵件 招標".split(),
)
ESSAY_LEVELS = (
    "權益 落差 困境 風險 倫理 跨網絡 跨專業 社工角色 專業責任 人力不足 執業環境 保護 安置 家庭照顧 復元 去污名 合理調整 自立生活 社會安全網 制度改善 爭議 通報 保護令 社工 專業 家庭照顧者 跨網絡".split(),
    "政策 制度 服務 支持 福利 權益保障 方案".split(),
    "宣導 活動 記者會 響應 倡議活動".split(),
)
ESSAY_RAISED = "社工專業與社福制度 兒少保護 家暴與性暴力 身障與人權".split()
FACT_PATTERNS = (r"[0-9]{1,3}[,，][0-9]{3}", "每月", "每年", "追溯自", "自[0-9]+年", "第[0-9]+條", "主管機關", "衛福部", "內政部", "勞動部", "施行細則", "補助方案")
FACT_TERMS = "補助 津貼 給付 服務 制度 法規 調查 辦法 條例".split()
FOCUS_AGENCIES = "衛福部 衛生福利部 內政部 勞動部 教育部 法務部 行政院 考試院 國民健康署".split()
