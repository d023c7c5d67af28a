"""Row and document schemas. Nothing is inferred; unknown keys are dropped on read."""

from __future__ import annotations

RESUME_CONTENT = """
struct<
  basics: struct<name: string, label: string, email: string, phone: string,
                 url: string, location: string, summary: string>,
  experience: array<struct<company: string, title: string, location: string,
                           start: string, end: string, bullets: array<string>>>,
  education: array<struct<institution: string, degree: string, location: string,
                          start: string, end: string, bullets: array<string>>>,
  skills: array<struct<category: string, items: array<string>>>,
  projects: array<struct<name: string, description: string, url: string, bullets: array<string>>>,
  custom: array<struct<title: string, bullets: array<string>>>
>
"""

LISTING_COLUMNS = (
    "external_id", "title", "company", "location", "url", "description", "posted_at", "remote",
    "source",
)

GREENHOUSE = """
jobs array<struct<id: string, title: string, absolute_url: string, updated_at: string,
  content: string, location: struct<name: string>, company_name: string>>
"""
LEVER = """
array<struct<id: string, text: string, hostedUrl: string, createdAt: bigint,
  workplaceType: string, description: string, descriptionPlain: string,
  categories: struct<location: string, team: string, commitment: string>>>
"""
ASHBY = """
jobs array<struct<id: string, title: string, jobUrl: string, location: string,
  isRemote: boolean, publishedAt: string, descriptionPlain: string, organizationName: string>>
"""
REMOTIVE = """
jobs array<struct<id: string, title: string, company_name: string,
  candidate_required_location: string, url: string, description: string,
  publication_date: string>>
"""
JSEARCH = """
data array<struct<job_id: string, job_title: string, employer_name: string, job_city: string,
  job_state: string, job_apply_link: string, job_description: string,
  job_posted_at_datetime_utc: string, job_is_remote: boolean>>
"""
ADZUNA = """
results array<struct<id: string, title: string, company: struct<display_name: string>,
  location: struct<display_name: string>, redirect_url: string, description: string,
  created: string>>
"""
PEOPLE = """
people array<struct<name: string, title: string, email: string, linkedin_url: string,
  organization: struct<name: string>>>
"""

FIT_REPLY = """
ratings array<struct<externalId: string, tier: string,
  reasons: array<struct<text: string, citations: array<string>, gap: boolean>>>>
"""
