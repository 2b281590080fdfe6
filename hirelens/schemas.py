"""Schemas of the documents and of the declared relational model."""

from __future__ import annotations

RESUME_INFO = "struct<skills: array<string>, experience: array<struct<title: string, company: string, duration: string, description: string>>, education: array<struct<degree: string, institution: string, graduationDate: string>>, certifications: array<string>>"
LLM_MATCH = "struct<matchScore: double, reasons: string, matchedSkills: array<string>, missingSkills: array<string>>"
JOB_REQUIREMENTS = "struct<keySkills: array<string>, requiredExperience: array<string>, essentialQualifications: array<string>>"
CANDIDATE = f"id string, name string, fileName string, extractedInfo {RESUME_INFO}, matchResults {LLM_MATCH}, status string, errorMessage string"
JOB_ANALYSIS = "title string, description string, keySkills array<string>, requiredExperience array<string>, essentialQualifications array<string>, status string"
TALENT_POOL = f"id string, name string, fileName string, skills array<string>, matchScore double, jobTitle string, extractedInfo {RESUME_INFO}, matchResults {LLM_MATCH}, shortlisted boolean, addedAt bigint"
JOB_POSTINGS = "id string, title string, description string, keySkills array<string>, department string, location string, type string, createdAt bigint, candidateCount bigint"
HISTORY = f"id string, timestamp bigint, jobTitle string, jobAnalysis struct<{JOB_ANALYSIS}>, candidates array<struct<{CANDIDATE}>>"
BLOBS = "id string, file binary"

STATUSES = ("idle", "processing", "completed", "error")
JOB_STATUSES = ("idle", "analyzing", "completed", "error")
EMPLOYMENT = ("Full-time", "Part-time", "Contract", "Internship")

#: The ten declared entities.
ENTITIES = {
    "Resume": "id string not null, originalFileName string not null, originalFileContent string not null, parsedRawText string not null, uploadDateTime timestamp not null, parsedName string not null, parsedEmail string, parsedPhone string, parsedLocation string, parsedSummary string, skillIds array<string>, educationIds array<string>, experienceIds array<string>, certificationIds array<string>, tfidfEmbeddingStorageReference string, bertEmbeddingStorageReference string, uploaderId string",
    "JobDescription": "id string not null, title string not null, company string not null, location string, description string not null, parsedRawText string not null, uploadDateTime timestamp not null, externalId string, skillIds array<string>, jobEducationRequirementIds array<string>, jobExperienceRequirementIds array<string>, jobCertificationRequirementIds array<string>, tfidfEmbeddingStorageReference string, bertEmbeddingStorageReference string, uploaderId string",
    "Skill": "id string not null, name string not null, category string",
    "Education": "id string not null, degree string not null, fieldOfStudy string not null, institution string not null, startDate date not null, endDate date, grade string, resumeId string not null",
    "Experience": "id string not null, title string not null, company string not null, startDate date not null, endDate date, description string not null, resumeId string not null",
    "Certification": "id string not null, name string not null, issuingAuthority string not null, issueDate date not null, expirationDate date, resumeId string not null",
    "JobEducationRequirement": "id string not null, jobDescriptionId string not null, degreeKeywords array<string>, fieldOfStudyKeywords array<string>, isPreferred boolean not null, description string not null",
    "JobExperienceRequirement": "id string not null, jobDescriptionId string not null, minimumYears double not null, relevantKeywords array<string>, isPreferred boolean not null, description string not null",
    "JobCertificationRequirement": "id string not null, jobDescriptionId string not null, nameKeywords array<string>, isPreferred boolean not null, description string not null",
    "MatchResult": "id string not null, resumeId string not null, jobDescriptionId string not null, tfidfScore double not null, bertScore double not null, skillMatchWeight double not null, finalScore double not null, matchDateTime timestamp not null",
}
#: Child entity: (its column, parent).
FOREIGN_KEYS = {
    "Education": [("resumeId", "Resume")],
    "Experience": [("resumeId", "Resume")],
    "Certification": [("resumeId", "Resume")],
    "JobEducationRequirement": [("jobDescriptionId", "JobDescription")],
    "JobExperienceRequirement": [("jobDescriptionId", "JobDescription")],
    "JobCertificationRequirement": [("jobDescriptionId", "JobDescription")],
    "MatchResult": [("resumeId", "Resume"), ("jobDescriptionId", "JobDescription")],
}
