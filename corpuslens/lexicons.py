"""Named term lists and rules of the source corpus; every operator takes its own as parameters."""

from __future__ import annotations

# fixed values: word lists, name parts and patterns
ACTOR_PARTY = {
    "赖清德": "DPP", "賴清德": "DPP", "萧美琴": "DPP", "蕭美琴": "DPP", "侯友宜": "KMT", "侯友谊": "KMT", "赵少康": "KMT", "趙少康": "KMT", "柯文哲": "TPP", "吴欣盈": "TPP", "吳欣盈": "TPP",
    "民进党": "DPP", "民進黨": "DPP", "国民党": "KMT", "國民黨": "KMT", "民众党": "TPP", "民眾黨": "TPP", "绿营": "DPP", "綠營": "DPP", "蓝营": "KMT", "藍營": "KMT", "白营": "TPP", "白營": "TPP",
}
INSTITUTION_CATEGORY = {
    "政见发表会": "procedure", "政見發表會": "procedure", "辩论": "procedure", "辯論": "procedure", "立法院": "institution", "表决": "procedure", "表決": "procedure", "ECFA": "policy", "修宪": "constitutional", "修憲": "constitutional",
    "核能": "energy", "社宅": "housing", "两岸": "cross-strait", "兩岸": "cross-strait", "国家认同": "identity", "國家認同": "identity", "国旗": "symbol", "國旗": "symbol", "三读": "procedure", "三讀": "procedure", "院会": "procedure", "院會": "procedure",
}
PROCEDURAL = (
    "政见发表会", "政見發表會", "辩论", "辯論", "三读", "三讀", "表决", "表決", "院会", "院會", "造势", "造勢", "扫街", "掃街", "拜票", "号次", "號次", "抽签", "抽籤",
    "升旗", "挥舞国旗", "揮舞國旗", "集会", "集會", "游行", "遊行", "动员", "動員", "协商", "協商", "版本", "草案", "投票",
)
EVENT_PHASES = (
    ("debate/manifesto", ("政见", "辩论", "政見", "辯論")),
    ("legislative", ("表决", "三读", "版本", "協商", "协商", "表決", "三讀")),
    ("campaigning", ("造势", "拜票", "扫街", "掃街", "造勢")),
)
REGION = ("台湾", "臺灣", "台灣", "中华民国", "中華民國", "台北", "臺北", "高雄", "台中", "臺中", "本土", "在地", "我国", "我國")
BLACKLIST = ("抽奖", "抽獎", "中奖", "中獎", "博彩", "賭博", "导购", "導購", "团购", "團購", "优惠", "優惠", "促销", "促銷", "打折", "特价", "特價", "彩票", "彩券", "刮刮乐", "刮刮樂")
STRONG_KEYS = (
    "兩岸", "两岸", "台海", "主權", "主权", "國家認同", "国家认同", "一國兩制", "一国两制", "正名", "國防", "国防", "兵役", "軍演", "飞弹", "導彈", "解放軍", "海巡", "潛艦國造", "國艦國造",
    "經濟", "经济", "通膨", "物價", "房價", "核能", "核四", "再生能源", "風電", "光電", "缺電", "半導體", "台積電", "居住正義", "社宅", "年金", "健保", "長照", "托育", "移工", "原住民", "性別平權", "婚姻平權", "同婚",
    "大選", "總統", "立法院", "立委", "政見", "辯論", "投票", "不分區", "三讀", "質詢", "國旗", "國歌", "國徽", "國慶", "升旗", "轉型正義", "二二八", "歷史正義", "集體記憶", "共同體", "國格",
)
ANTI_KEYS = ("統一發票", "统一发票", "統一超商", "统一超商", "統一企業", "统一企业")
AMBIGUOUS = "統一(獅|發票|超商|企業)|國民(美食|旅遊)"
REGION_BUCKETS = (
    ("台灣", "臺灣", "中華民國"),
    ("立法院", "行政院", "中選會", "總統府", "國防部", "外交部"),
    ("總統", "立委", "政見", "辯論", "補選", "罷免", "三讀", "表決"),
    ("九二共識", "台獨", "統一", "反滲透法", "認知作戰", "台海", "邦交", "斷交"),
    ("台積電", "半導體", "能源", "核能", "電價", "預算", "稅制", "社宅", "年金", "健保"),
)
CANDIDATES = ((("01_ho", "hou", "侯"), "侯友宜"), (("02_ke", "柯"), "柯文哲"), (("03_lai", "lai", "赖", "賴"), "赖清德"))
PARTIES = (("侯友宜", "KMT"), ("柯文哲", "TPP"), ("赖清德", "DPP"))
CANDIDATE_NAMES = {"赖清德": "Lai (DPP)", "侯友宜": "Hou (KMT)", "柯文哲": "Ko (TPP)"}
CANDIDATE_SLUGS = {"赖清德": "Lai", "侯友宜": "Hou", "柯文哲": "Ko"}
SOURCE_TYPES_BY_FILE = ((("03_x_datasets", "x_datasets", "twitter"), "social_media"), (("conference", "debate"), "conference"))
SOURCE_TYPES_BY_SOURCE = ((("x_datasets", "twitter"), "social_media"), (("meeting", "conference"), "conference"))
OUTLETS = (
    (("chinatimes",), "China Times"), (("ltn",), "LTN (Liberty Times)"), (("tvbs",), "TVBS"), (("辩论", "debate"), "Televised debate"),
    (("meeting",), "Policy forum (televised)"), (("x_datasets",), "X (social media)"), (("专访",), "Candidate interview"),
)
PHASES = (("2023-07-01", "Primary season"), ("2023-11-25", "Nomination period"), ("2023-12-16", "Post-registration interregnum"), ("2024-01-12", "General campaign"), ("2024-01-14", "Final sprint / Election day"))
PROMO = (r"（.+?）(?:下載|订阅|訂閱|更多內容|點我|点我|延伸閱讀).{0,40}$", r"^\s*（(?:記者|记者).+?攝）\s*", r"透過\s*Google\s*News\s*$", r"編輯：.{2,10}\）\d{7}$")
EDITORS, COPYRIGHT_FROM = ("（編輯:", "（编辑:"), "本網站之文字"
COPYRIGHT_END = r"本網站之文字、圖片及影音[,，][^。]*非經授權[,，]不得轉載[、。.\s]*$"
BYLINE = r"（中央社記者[^）]*?電）"
EDITOR_RESIDUE = ((r"^（(?:編輯|编辑):[^）]+）\d*$", "editor_only"), (r"^\d{5,7}$", "date_only"), ("編輯|编辑", "editor_residue"))
LOW_PRIOR_PAIRS = (("L1-01", "L2-01"),)
