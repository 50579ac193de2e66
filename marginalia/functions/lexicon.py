"""Word lists that questions and evidence are read with, as plain values and as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# These words and patterns decide results, so they must be just these.
SYNONYMS = {
    "방법": "방법 절차 신청 신청절차 제출".split(),
    "주의사항": "주의사항 유의사항 유의 주의".split(),
    "전과": "전과 전과제도 전과시행".split(),
    "모집": "모집 모집인원 모집정원 정원".split(),
    "인원": "인원 모집인원 모집정원 정원".split(),
    "정원": "정원 모집인원 모집정원 인원".split(),
    "공식": "공식 수식".split(),
    "수식": "수식 공식".split(),
    "상수": "상수 계수 값".split(),
    "계수": "계수 상수 값".split(),
    "값": "값 수치".split(),
    "일정": "일정 기간 날짜".split(),
    "기간": "기간 일정 날짜".split(),
    "날짜": "날짜 일정 기간".split(),
}
GENERIC = "방법 절차 신청 주의사항 유의사항 모집 인원 정원 모집인원 모집정원 정보 알려줘 어디 어떤 뭐야 무엇".split()
FUNCTION_WORDS = "알려줘 어디 어떤 뭐야 무엇 무슨 언제 어떻게".split()
WEAK_SUBJECTS = "학생 재학생 학교 대학 우리 인하공업전문대학 인하공전".split()
TABLE_INTENT = "값 수치 공식 수식 상수 계수 인원 정원 모집 모집인원 모집정원 점수 가산점 등급 기간 날짜 일정 서류 자격 학과 과목 항목 복장 상의 하의 신발".split()
COLLECTIONS = "학과 과목 서류 시설 항목 종류 전형 대상".split()
WHERE_COLLECTIONS = "학과 과목 서류 항목 종류 전형 대상".split()
PLACES = "위치 장소 주소 소재지 몇층 층 호관".split()
LIST_ASKS = "어디 무엇 뭐 어떤 무슨 목록 종류".split()
WHERE_IS = "어디에있 어디있".split()
STATISTICS = "결과 평균 최저 최고 경쟁 경쟁률 예비 순위 등급".split()
COUNT_ASKS = "모집 인원 정원 모집인원 모집정원".split()
COUNT_COLUMN = r"(모집\s*정원|모집정원|합계|총|전체|total)\s*="
INTENTS = "location time cost attire documents eligibility count schedule method formula list".split()
INTENT_TERMS = {
    "list": "무엇 뭐 무슨 어떤 목록 종류 있어 있나요 있습니까 포함".split(),
    "location": "어디 위치 장소 주소 소재지 몇층 층 호관 찾아오".split(),
    "time": "시간 이용시간 운영시간 언제 몇시 기간 평일 주말 공휴일 방학".split(),
    "cost": "비용 금액 얼마 요금 가격 납부 원 무료".split(),
    "attire": "복장 옷 상의 하의 신발 티셔츠 스타킹 단화".split(),
    "documents": "서류 제출서류 증빙 첨부 제출 준비물".split(),
    "eligibility": "자격 지원자격 대상 조건 요건".split(),
    "count": "인원 정원 모집인원 모집정원 몇명 명".split(),
    "method": "방법 절차 어떻게 신청 진행 처리".split(),
    "schedule": "일정 날짜 기간 접수 발표 마감".split(),
    "formula": "공식 수식 계산 산식".split(),
}
EVIDENCE_TERMS = {
    "list": "시설 목록 종류 항목 포함 운영 이용".split(),
    "location": "위치 장소 주소 소재지 호관 층 도로 길 정문 후문 옆 앞 뒤 내 근처 캠퍼스".split(),
    "time": "시간 이용 이용시간 운영시간 기간 평일 주말 공휴일 방학 중식 휴무 운영".split(),
    "cost": "비용 금액 요금 가격 납부 원 무료 환불".split(),
    "attire": "복장 수험생 상의 하의 신발 티셔츠 스타킹 단화 바지 스커트".split(),
    "documents": "서류 제출서류 증빙 첨부 제출 발급 원본 사본".split(),
    "eligibility": "자격 대상 조건 요건 해당자 지원".split(),
    "count": "인원 정원 모집 모집인원 모집정원 명 합계 총".split(),
    "method": "방법 절차 신청 제출 접수 처리 승인".split(),
    "schedule": "일정 날짜 기간 접수 발표 마감 등록".split(),
    "formula": "공식 수식 계산 산식 계수 상수 값".split(),
}
EVIDENCE_PATTERNS = {
    "location": [r"\d+\s*호관", r"\d+\s*층", r"(정문|후문|도로|길|로|동|번지)\s*(앞|옆|뒤|근처|내)?"],
    "time": [r"\d{1,2}\s*:\s*\d{2}", r"\d{1,2}\s*시", r"(평일|주말|공휴일|방학|중식|휴무)"],
    "cost": [r"\d[\d,]*\s*원", r"(무료|비용|금액|요금)"],
    "attire": [r"(상의|하의|신발)\s*[:：]", r"(흰색\s*반팔\s*티셔츠|스커트|스타킹|단정한\s*바지|단화)"],
    "count": [r"\d[\d,]*\s*명", r"(모집\s*정원|모집\s*인원|합계|총)\s*[=:]?\s*\d+"],
    "list": [r"^\s*[-*]\s+", r".+\s*:\s*.+"],
}
NON_SUBJECTS = [
    r"^(몇)?명(이야|인가요|인가|인지|입니까|이에요|예요)?$",
    r"^(몇)?시(야|인가요|인가|인지|입니까|이에요|예요)?$",
    r"^(어디|언제|무엇|뭐|어떤|무슨|어떻게)(.*)?$",
    r"^(있어|있나요|있습니까|돼|되나요|될까|인가요)$",
]
LOCAL_INTENTS = "location time cost count attire".split()
FOCUSED_INTENTS = "location time cost count list attire documents eligibility method schedule formula".split()
BRIDGE_INTENTS = "attire documents eligibility count method schedule time cost location formula list".split()
DIRECT_INTENTS = "count formula".split()
DEFAULT_LABELS = {
    "attire": "복장",
    "documents": "준비물/서류",
    "eligibility": "자격",
    "count": "인원",
    "list": "목록",
    "method": "방법",
    "schedule": "일정",
    "time": "시간",
    "cost": "비용",
    "location": "위치",
    "formula": "공식",
}
CONTEXT_LABELS = "면접 정시 수시1차 수시2차 수시".split()
LABEL_KEYS = "구분 분류 유형".split()
LABEL_VALUES = "수시 정시 수시1차 수시2차".split()
ATTIRE = "상의 하의 신발 티셔츠 스커트 스타킹 바지 단화".split()
SUBJECT_LABELS = ["모집단위", "학과", "항목", "요소", "구분", "전형", "프로젝트 유형"]
GRADES = ["매우 낮음", "낮음", "정상", "높음", "매우 높음", "극히 높음"]
NOTE_PREFIXES = ["※", "- ※", "* ※", "주)", "주:", "비고", "참고", "단위", "범례", "legend"]
NOTE_SYMBOLS = "♣ ■ □ ◈ ○ ● ★ ☆".split()
NOTE_WORDS = "표시 기호 해당 제외 제한 불가 가능 선택 필수 모집 전형".split()
LEGEND_SYMBOLS = "♣■□◆◇◈●○◎△▲▣★☆※"
SUBJECT_SYMBOLS = "♣■◈◆◇□●○▲△★☆"


def lexicon(spark: SparkSession) -> DataFrame:
    """intent, priority, kind (asked or evidence) and term: the intents' word lists as a table of a few hundred rows."""
    rows = [(i, INTENTS.index(i), kind, t) for kind, lists in (("asked", INTENT_TERMS), ("evidence", EVIDENCE_TERMS)) for i, terms in lists.items() for t in terms]
    return spark.createDataFrame(rows, "intent string, priority int, kind string, term string")
