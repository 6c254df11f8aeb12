"""Pattern sets and word lists: the Korean defaults of the domain, and Latin ones for other corpora.

Fixed values, in the order in which the operators apply them.
"""

from __future__ import annotations

AGENCY_KO = [
    r"발주기관\s*[:：]\s*([^\n\r]+)",
    r"발주청\s*[:：]\s*([^\n\r]+)",
    r"발주처\s*[:：]\s*([^\n\r]+)",
    r"주관기관\s*[:：]\s*([^\n\r]+)",
    r"계약기관\s*[:：]\s*([^\n\r]+)",
    r"(?U)(한국\w+(?:공단|공사|연구원|재단|진흥원|개발원))",
    r"(?U)(\w+(?:대학교|대학))",
    r"(?U)(\w+(?:특별시|광역시|도))",
    r"(?U)(\w+(?:시청|구청|군청|도청))",
]
BUSINESS_KO = {
    "정보시스템구축": [r"시스템\s*구축", r"시스템\s*개발", r"플랫폼\s*구축"],
    "정보시스템고도화": [r"시스템\s*고도화", r"시스템\s*개선", r"기능개선"],
    "ISP/ISMP": [r"ISP\s*수립", r"ISMP\s*수립", r"정보화전략계획"],
    "홈페이지구축": [r"홈페이지\s*구축", r"웹사이트\s*구축", r"포털\s*구축"],
    "PMC용역": [r"PMC\s*용역", r"사업관리", r"프로젝트\s*관리"],
    "운영용역": [r"운영\s*용역", r"시스템\s*운영"],
    "ERP구축": [r"ERP\s*구축", r"전사적\s*자원관리"],
    "보안시스템": [r"보안\s*시스템", r"사이버\s*보안"],
    "조사연구": [r"실태조사", r"현황조사", r"연구\s*용역"],
}
BUSINESS_DEFAULT = "기타"
BUDGET_KO = [
    r"예산\s*[:：]?\s*([0-9,]+)\s*원",
    r"사업비\s*[:：]?\s*([0-9,]+)\s*원",
    r"총\s*사업비\s*[:：]?\s*([0-9,]+)\s*원",
    r"계약금액\s*[:：]?\s*([0-9,]+)\s*원",
    r"([0-9,]+)\s*억\s*원",
    r"([0-9,]+)\s*천만\s*원",
    r"금\s*([0-9,]+)\s*원",
    r"(\d{1,3}(?:,\d{3})*)\s*원",
    r"예산\s*(\d{1,3}(?:,\d{3})*)",
    r"([0-9]+억[0-9,]*만?원)",
    r"총액\s*[:：]?\s*([0-9,]+)\s*원",
    r"사업규모\s*[:：]?\s*([0-9,]+)\s*원",
]
DEADLINE_KO = [
    r"제출마감\s*[:：]\s*(\d{4}[년.-]\d{1,2}[월.-]\d{1,2}일?)",
    r"접수마감\s*[:：]\s*(\d{4}[년.-]\d{1,2}[월.-]\d{1,2}일?)",
    r"제안서\s*제출\s*[:：]\s*(\d{4}[년.-]\d{1,2}[월.-]\d{1,2}일?)",
    r"마감일시\s*[:：]\s*(\d{4}[년.-]\d{1,2}[월.-]\d{1,2}일?)",
]
DEADLINE_UNTIL_KO = r"(\d{4})[년.-](\d{1,2})[월.-](\d{1,2})일?\s*까지"
#: The second set of patterns: (column, group of the match, patterns).
NOTICE_KO = (
    ("budget", 0, [r"(?iu)총\s*사업비\s*[:\s]*([0-9,]+)\s*(원|백만원|억원)", r"(?iu)예산\s*[:\s]*([0-9,]+)\s*(원|백만원|억원)", r"(?iu)금액\s*[:\s]*([0-9,]+)\s*(원|백만원|억원)"]),
    ("business_name", 1, [r"(?iu)사업명\s*[:\s]*([^\n]+)", r"(?iu)과업명\s*[:\s]*([^\n]+)", r"(?iu)프로젝트명\s*[:\s]*([^\n]+)"]),
    ("agency", 1, [r"(?iu)발주기관\s*[:\s]*([^\n]+)", r"(?iu)주관기관\s*[:\s]*([^\n]+)", r"(?iu)발주처\s*[:\s]*([^\n]+)"]),
    ("deadline", 1, [r"(?iu)마감일\s*[:\s]*(\d{4}[.-]\d{1,2}[.-]\d{1,2})", r"(?iu)제출기한\s*[:\s]*(\d{4}[.-]\d{1,2}[.-]\d{1,2})", r"(?iu)접수마감\s*[:\s]*(\d{4}[.-]\d{1,2}[.-]\d{1,2})"]),
)
#: Headers of sections, matched at a line's start.
HEADER_KO = r"^(?:\d+\.\s*[가-힣]+|[가-힣]+\s*:\s*|\[[가-힣]+\]|제\s*\d+\s*장)"
HEADER_LATIN = r"^[^.]{1,59}[.]?$"

DEADLINE_LATIN = [r"dated?\s*[:：]?\s*(\d{4}[.-]\d{1,2}[.-]\d{1,2})", r"(\d{4}-\d{1,2}-\d{1,2})"]
UNTIL_LATIN = r"(\d{2,4})[./](\d{1,2})[./](\d{1,2})"
NOTICE_LATIN = (
    ("budget", 0, [r"(?iu)version\s*[:\s]*([0-9,]+)", r"(?iu)([0-9,]+)\s*(words|items)"]),
    ("business_name", 1, [r"(?iu)under the\s+([^\n.]+)", r"(?iu)about\s+([^\n.]+)"]),
    ("agency", 1, [r"(?iu)the ([a-z]+) license"]),
    ("deadline", 1, [r"(?iu)(\d{4}[.-]\d{1,2}[.-]\d{1,2})"]),
)
AGENCY_LATIN = [r"the (GNU General Public) License", r"the ([A-Z][A-Za-z]+) License", r"under (CC BY[A-Z-]*) "]
BUSINESS_LATIN = {"license": [r"[Ll]icense", r"[Rr]eleased under"], "english": [r" the ", r" of "], "german": [r" der ", r" und "], "french": [r" le ", r" les "], "spanish": [r" que ", r" el "]}
BUDGET_LATIN = [r"[Vv]ersion ([0-9,]+)", r"([0-9,]+)"]

#: Head word and members, in order.
THESAURUS_KO = {
    "예산": ["비용", "금액", "총액", "소요비용", "사업비", "투자비", "재정", "자금", "예산안"],
    "비용": ["예산", "금액", "총액", "소요비용", "사업비", "투자비", "경비", "지출"],
    "가격": ["단가", "비용", "금액", "요금", "가액", "값"],
    "일정": ["스케줄", "계획", "기간", "납기", "완료일", "종료일", "시간표"],
    "기간": ["일정", "소요시간", "수행기간", "개발기간", "납기"],
    "완료": ["종료", "마감", "끝", "완성", "달성", "수행완료"],
    "기술": ["테크놀로지", "솔루션", "방법론", "기법", "스킬"],
    "시스템": ["플랫폼", "서비스", "솔루션", "체계", "구조"],
    "개발": ["구축", "제작", "구현", "생성", "작성", "설계"],
    "구축": ["개발", "구현", "설치", "설정", "배포", "세팅"],
    "요구사항": ["필요사항", "조건", "스펙", "규격", "기준", "조건사항"],
    "규격": ["스펙", "사양", "기준", "표준", "조건"],
    "성능": ["퍼포먼스", "속도", "처리량", "효율성", "능력"],
    "인력": ["인원", "담당자", "개발자", "팀", "조직", "인적자원"],
    "담당자": ["책임자", "매니저", "관리자", "PM", "리더"],
    "업체": ["회사", "기업", "업체", "사업자", "공급업체", "벤더"],
    "보안": ["시큐리티", "암호화", "인증", "방화벽", "접근제어"],
    "암호화": ["보안", "인크립션", "해시", "키"],
    "제안서": ["제안요청서", "RFP", "사업계획서", "기획서"],
    "계약": ["협약", "약정", "계약서", "협정"],
    "품질": ["퀄리티", "수준", "등급", "완성도"],
    "테스트": ["시험", "검증", "점검", "확인", "검사"],
}
#: Whole words replaced in this order: easy, middle, advanced.
VOCABULARY_KO = [
    ("돈", "예산"), ("비용", "예산"), ("만들기", "개발"), ("만든다", "구축한다"), ("언제", "일정"), ("얼마나", "기간"), ("뭐", "무엇"), ("어떤", "어떠한"), ("좋은", "우수한"), ("빠른", "신속한"), ("쉬운", "간편한"), ("어려운", "복잡한"),
    ("시스템", "플랫폼"), ("프로그램", "애플리케이션"), ("데이터", "정보"), ("서버", "서버시스템"),
    ("아키텍처", "시스템구조"), ("인프라", "기반구조"), ("솔루션", "해결방안"),
]
#: Intent: words that show it, words that strengthen it, its category of questions.
INTENTS_KO = [
    ("budget", ["얼마", "비용", "예산", "돈"], ["예산", "비용", "금액"], "예산"),
    ("schedule", ["언제", "일정", "기간", "완료"], ["일정", "기간", "완료"], "일정"),
    ("technical", ["어떻게", "방법", "기술", "시스템"], ["기술", "시스템", "방법"], "기술"),
    ("personnel", ["누구", "담당자", "인력", "팀"], ["인력", "담당자", "팀"], "인력"),
    ("security", ["보안", "암호화", "인증"], ["보안", "암호화", "인증"], "보안"),
]
CONTEXTS_KO = {
    "웹시스템": ["웹사이트", "홈페이지", "인터넷", "UI/UX", "브라우저", "반응형"],
    "모바일": ["앱", "스마트폰", "태블릿", "iOS", "안드로이드", "크로스플랫폼"],
    "데이터베이스": ["DB", "SQL", "NoSQL", "저장", "조회", "백업"],
    "AI": ["인공지능", "머신러닝", "딥러닝", "자동화", "예측", "분석"],
    "클라우드": ["AWS", "Azure", "GCP", "호스팅", "SaaS", "IaaS"],
}
TEMPLATES_KO = {
    "예산": ["총 사업예산은 얼마인가요?", "예산 규모는 어느 정도인가요?", "투자비용은 얼마나 필요한가요?", "사업비 범위를 알려주세요", "소요예산 규모는?", "총 비용은 얼마나 되나요?", "예산 한도는 어떻게 되나요?", "경비 규모가 궁금합니다"],
    "일정": ["사업 일정은 어떻게 되나요?", "개발 기간은 얼마나 걸리나요?", "완료 예정일은 언제인가요?", "납기는 어떻게 되나요?", "수행 기간이 궁금합니다", "언제까지 완료해야 하나요?", "스케줄 계획을 알려주세요", "마감일정이 있나요?"],
    "기술": ["어떤 기술을 사용하나요?", "기술 스택은 무엇인가요?", "개발 기술이 궁금합니다", "어떤 솔루션을 쓰나요?", "기술적 요구사항은?", "플랫폼 환경은 어떻게 되나요?", "개발 방법론은 무엇인가요?", "기술 아키텍처를 알려주세요"],
    "요구사항": ["필수 요구사항은 무엇인가요?", "기능 요구사항을 알려주세요", "시스템 요구사항은?", "어떤 조건들이 있나요?", "필요한 기능은 무엇인가요?", "성능 요구사항이 궁금합니다", "규격 조건은 어떻게 되나요?", "어떤 스펙이 필요한가요?"],
    "인력": ["필요한 인력 규모는?", "팀 구성은 어떻게 되나요?", "담당자는 몇 명인가요?", "개발 인원이 궁금합니다", "프로젝트 팀원 구성은?", "인적 자원 계획은?", "역할별 담당자는?", "조직 구성도를 알려주세요"],
    "보안": ["보안 요구사항은 무엇인가요?", "보안 조치는 어떻게 되나요?", "암호화 방법은?", "접근 제어 방식은?", "보안 정책이 있나요?", "인증 시스템은 어떻게?", "방화벽 설정은?", "보안 수준은 어느 정도인가요?"],
}
CATEGORY_OF_KO = {"예산": "예산", "비용": "예산", "가격": "예산", "일정": "일정", "기간": "일정", "완료": "일정", "기술": "기술", "시스템": "기술", "개발": "기술", "구축": "기술", "요구사항": "요구사항", "규격": "요구사항", "성능": "요구사항", "인력": "인력", "담당자": "인력", "업체": "인력", "보안": "보안", "암호화": "보안"}
STOPWORDS_KO = ["은", "는", "이", "가", "을", "를", "에", "에서", "로", "으로", "와", "과", "의", "도", "만", "부터", "까지", "라서", "이므로", "그리고", "또한", "하지만", "그러나", "따라서", "그래서", "즉", "또는", "및", "등", "기타"]
HIGH_KO = ["예산", "비용", "일정", "기간", "기술", "시스템", "요구사항", "성능"]
MEDIUM_KO = ["개발", "구축", "관리", "운영", "테스트", "품질"]

THESAURUS_LATIN = {"the": ["le", "der", "el", "la"], "of": ["de", "von", "des"], "and": ["und", "et", "y"], "to": ["zu", "pour", "para"], "la": ["el", "los", "le"]}
VOCABULARY_LATIN = [("a", "an"), ("is", "be"), ("thing", "item"), ("el", "los")]
INTENTS_LATIN = [("article", ["the", "der"], ["the", "le"], "the"), ("link", ["and", "und", "est"], ["and", "et"], "and"), ("place", ["in", "zu", "dans"], ["in", "zu"], "of")]
CONTEXTS_LATIN = {"english": ["with", "that"], "german": ["nicht", "sich"], "french": ["avec", "dans"], "spanish": ["para", "con"]}
TEMPLATES_LATIN = {"the": ["what is the", "which is the", "where is the", "who has the"], "and": ["what and why", "this and that"], "of": ["part of what", "kind of thing", "out of where"]}
CATEGORY_OF_LATIN = {"the": "the", "la": "the", "and": "and", "of": "of"}
STOPWORDS_LATIN = ["is", "be", "on", "in", "es", "en", "du", "au", "zu"]
HIGH_LATIN, MEDIUM_LATIN = ["the", "la", "der"], ["and", "of"]
