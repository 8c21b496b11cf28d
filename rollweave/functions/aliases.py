"""Names under which feeds of people records deliver the same information (fixed values)."""

from __future__ import annotations

import re

#: Canonical field -> other names of it, in the order in which they are looked up.
FIELD_ALIASES: dict[str, tuple[str, ...]] = {
    "applicant_name": ("name", "full_name", "candidate_name", "candidate", "applicant", "name_of_applicant"),
    "contact_email": ("email", "email_address", "primary_email", "e_mail", "mail"),
    "contact_phone": ("phone", "phone_number", "mobile", "telephone", "mobile_number"),
    "current_employer": ("company", "employer", "current_company", "organization"),
    "job_title": ("title", "role", "position", "current_title", "current_role"),
    "location_city": ("city", "town"),
    "location_state": ("state", "region", "province"),
    "location_country": ("country", "country_name", "nation"),
    "skills_list": ("skills", "skillset", "skill_set", "tech_stack", "technologies"),
    "years_of_experience": ("experience_years", "yoe", "years_experience", "years", "total_experience"),
}


def plain_key(name: str) -> str:
    """A key in lower snake case: ``contactEmail`` and ``Contact-Email`` give ``contact_email``."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return re.sub(r"[^a-z0-9]+", "_", spaced.lower()).strip("_")

