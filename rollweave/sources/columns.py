"""Names under which delimited files deliver the fields of a record (fixed values)."""

from __future__ import annotations

import re

#: Clean column -> field.
FIELDS: dict[str, str] = {
    "name": "full_name", "email": "emails", "phone": "phones", "current_company": "current_company", "title": "title", "location": "location.city", "city": "location.city", "state": "location.region", "country": "location.country",
    "linkedin": "links.linkedin", "github": "links.github", "portfolio": "links.portfolio", "skills": "skills", "years_experience": "years_experience",
}

#: Other name -> clean column.
ALIASES: dict[str, str] = {
    "candidate": "name", "candidate_name": "name", "full_name": "name", "applicant": "name", "applicant_name": "name", "email_address": "email", "primary_email": "email", "contact_email": "email", "mobile": "phone", "phone_number": "phone",
    "contact_phone": "phone", "company": "current_company", "employer": "current_company", "current_employer": "current_company", "job_title": "title", "role": "title", "position": "title", "current_title": "title", "location_city": "city",
    "location_state": "state", "region": "state", "location_country": "country", "linkedin_url": "linkedin", "github_url": "github", "portfolio_url": "portfolio", "website": "portfolio", "personal_site": "portfolio", "skills_list": "skills",
    "tech_stack": "skills", "years_of_experience": "years_experience", "yoe": "years_experience",
}


def clean_column(raw: str) -> str:
    """A header in lower case, other signs than letters and digits as one underscore, by its clean name."""
    c = re.sub(r"[^a-z0-9]+", "_", raw.lower()).strip("_")
    return ALIASES.get(c, c)
