"""What planner and coder are asked, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the requests.
PLAN_ASK = (
    "Create an implementation plan for this HumanEval task.\n"
    "Start with exactly one line: Estimated effort tokens: N\n"
    "N is your estimate of total coder output tokens needed to solve the task, between 80 and 800.\n"
    "Then mention the core algorithm and key edge cases. Do not write code.\n\n"
)
PLAN_AGAIN = "The previous code did not fully solve the task. Give a repair plan for the coder.\nMention only the likely defect and the next correction. Do not write code.\n\n"
CODE_ASK = "Now write the complete Python function."
CODE_AGAIN = "Now write a corrected complete Python function."
CODE_ONLY = "Return only valid Python code. Do not include markdown fences, prose, tests, or examples."
LEADER_ROLE = "You are the leader/planner in a planner-coder code generation team. Give concise, actionable guidance. Do not write code. The coder will implement exactly one Python function."
FOLLOWER_ROLE = "You are the follower/coder in a planner-coder code generation team. " + CODE_ONLY
PLANNER_ROLE = (
    "You are the planner in a planner-coder code generation team. Your job is to provide a concise implementation plan, key edge cases, and repair guidance. "
    "Do not write code. Keep the plan actionable and short."
)
CODER_ROLE = "You are the coder in a planner-coder code generation team. " + CODE_ONLY
PLAIN_PLAN_ASK = "Create an implementation plan for this HumanEval task. Mention edge cases the coder must handle.\n\n"
DIAGNOSE = (
    "Diagnose the concrete defect from the failed assertions, then give the smallest correction the coder should make. Do not write code.\n"
    "Use this exact structure:\n"
    "Likely defect: <one sentence>\n"
    "Evidence: <cite the failed assertion or error>\n"
    "Minimal correction: <one sentence>\n"
    "Preserve: <behavior from the previous code that should not change>\n\n"
)
SMALLEST_CHANGE = " Make the smallest necessary logical change and preserve behavior that already passed."
INCENTIVE = ("Incentive rule: execution improvements are rewarded by incremental pass-rate gain. Remaining trajectory incentive budget is about ", "; per-step payment is capped at ", "; current best pass rate is ", ".")
NO_INCENTIVE = "Incentive rule: none."
EXPERT, DEBUGGER = "You are an expert Python programmer. ", "You are an expert Python debugger. "
TEAM_DEBUGGER = "You are the debugger in an AgentCoder-style team. "
CORRECTED_ONLY = "Return only corrected Python code. Do not include markdown fences, prose, tests, or examples."
THINK_ROLE = EXPERT + "Think through the algorithm briefly, then provide the final complete Python function. The final answer must contain valid Python code."
THINK_FORM = "Use this format:\nReasoning: <brief reasoning>\nFinal code:\n```python\n<code>\n```"
TEAM_REPAIR = "Repair the implementation. Keep correct behavior and make the smallest necessary change."
TESTER_ROLE = "You are the tester in an AgentCoder-style team. Do not write final code. Identify likely edge cases and possible defects in the programmer's solution."
TESTER_ASK = "Give concise tester feedback."
DEBATER = " in a multi-agent debate for Python code generation. Do not write code. Give concise algorithmic advice and edge cases."
DEBATE_ASK = "Analyze this HumanEval task for implementation:\n\n"
DEBATE_END_ROLE = "You are the final coder after a multi-agent debate. " + CODE_ONLY
TASK, BEFORE, FEEDBACK, GUIDANCE, REPAIR = "Task:\n", "Previous code:\n", "Execution feedback:\n", "Planner guidance:\n", "Planner repair guidance:\n"


def _parts(*parts: tuple[str, Column]) -> Column:
    """Headed parts with an empty line between them; a null part is empty."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(head), F.coalesce(body, F.lit(""))) for head, body in parts))


def leader_state(task_id: Column, entry_point: Column, prompt: Column) -> Column:
    lines = (F.concat(F.lit("Task ID: "), task_id), F.concat(F.lit("Entry point: "), entry_point), F.lit("Task prompt:"), prompt)
    return F.concat_ws("\n", *lines)


def planner_request(round_: Column, prompt: Column, code_before: Column, feedback: Column) -> Column:
    """The user message to the planner: a plan in the first round, a repair plan later."""
    again = F.concat(F.lit(PLAN_AGAIN), _parts((TASK, prompt), (BEFORE, code_before), (FEEDBACK, feedback)))
    return F.when(round_ == 1, F.concat(F.lit(PLAN_ASK), prompt)).otherwise(again)


def coder_request(round_: Column, prompt: Column, plan: Column, code_before: Column, feedback: Column, incentive: Column) -> Column:
    """The user message to the coder; later rounds also show the code before and what came of it."""
    first = _parts((TASK, prompt), (GUIDANCE, plan), ("", incentive), ("", F.lit(CODE_ASK)))
    again = _parts((TASK, prompt), (BEFORE, code_before), (FEEDBACK, feedback), (REPAIR, plan), ("", incentive), ("", F.lit(CODE_AGAIN)))
    return F.when(round_ == 1, first).otherwise(again)


@dataclass(frozen=True)
class Profile:
    """The wording of a loop's requests: roles, what is asked first and again, and whether the first code request names the incentive."""

    planner_role: str = LEADER_ROLE
    coder_role: str = FOLLOWER_ROLE
    plan_ask: str = PLAN_ASK
    plan_again: str = PLAN_AGAIN
    code_again: str = CODE_AGAIN
    incentive_first: bool = True


#: Sampling of trajectories; evaluation in the words of training; evaluation in plain words.
SAMPLING = Profile()
ALIGNED = Profile(plan_again="The previous code did not fully solve the task. " + DIAGNOSE, code_again=CODE_AGAIN + SMALLEST_CHANGE)
PLAIN = Profile(PLANNER_ROLE, CODER_ROLE, PLAIN_PLAN_ASK, "The previous code failed. " + DIAGNOSE, CODE_AGAIN + SMALLEST_CHANGE, incentive_first=False)


def message(system: Column | str, user: Column) -> Column:
    """struct<system, user>."""
    return F.struct((F.lit(system) if isinstance(system, str) else system).alias("system"), user.alias("user"))


def _fixed(x: Column, digits: int) -> Column:
    return F.replace(F.format_number(x, digits), F.lit(","))


def incentive_rule(budget: Column, max_step: Column, best: Column) -> Column:
    """What the coder is told of its pay: four decimals for money, three for the pass rate."""
    a, b, c, d = map(F.lit, INCENTIVE)
    return F.concat(a, _fixed(budget, 4), b, _fixed(max_step, 4), c, _fixed(best, 3), d)


def planner_message(profile: Profile, round_: Column, prompt: Column, code_before: Column, feedback: Column) -> Column:
    again = F.concat(F.lit(profile.plan_again), _parts((TASK, prompt), (BEFORE, code_before), (FEEDBACK, feedback)))
    return message(profile.planner_role, F.when(round_ == 1, F.concat(F.lit(profile.plan_ask), prompt)).otherwise(again))


def coder_message(profile: Profile, round_: Column, entry_point: Column, prompt: Column, plan: Column, code_before: Column, feedback: Column, incentive: Column) -> Column:
    pay = [("", incentive)]
    first = _parts((TASK, prompt), (GUIDANCE, plan), *(pay if profile.incentive_first else []), ("", F.lit(CODE_ASK)))
    again = _parts((TASK, prompt), (BEFORE, code_before), (FEEDBACK, feedback), (REPAIR, plan), *pay, ("", F.lit(profile.code_again)))
    return message(F.concat(F.lit(profile.coder_role + " Define the function "), entry_point, F.lit(" exactly.")), F.when(round_ == 1, first).otherwise(again))


def follower_state(task_id: Column, entry_point: Column, prompt: Column, plan: Column, code_before: Column, feedback: Column, incentive: Column) -> Column:
    """What a coder's candidates are sampled from: the task, the turn before if there was one, the plan and the pay.

    feedback is the compact text, null where there was no turn before.
    """
    said = lambda head, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(head), x))
    return F.concat_ws("\n", leader_state(task_id, entry_point, prompt), said(BEFORE, code_before), said(FEEDBACK, feedback), F.concat(F.lit(GUIDANCE), F.coalesce(plan, F.lit(""))), incentive)


def state_message(entry_point: Column, state_text: Column) -> Column:
    """The request for candidates of a state."""
    user = F.concat(F.lit("Task state:\n"), state_text, F.lit("\n\nWrite the complete Python function `"), entry_point, F.lit("`. Return Python code only."))
    return message(F.concat(F.lit(FOLLOWER_ROLE + " Define the function "), entry_point, F.lit(" exactly.")), user)


def repair_request(state_text: Column, code_before: Column, feedback: Column) -> Column:
    """The human side of a repair example."""
    return F.concat(_parts(("Task state:\n", state_text), (BEFORE, code_before), (FEEDBACK, feedback)), F.lit("\n\nGive a concise repair plan for the coder. Do not write code."))


def direct_message(entry_point: Column, prompt: Column, extra: Column | None = None) -> Column:
    """Baselines: code at once, with something more to say at the end."""
    user = F.concat(F.lit("Solve this HumanEval problem. Provide a complete Python function named "), entry_point, F.lit(". Return only the code.\n\n"), prompt)
    return message(EXPERT + CODE_ONLY, user if extra is None else F.concat_ws("\n\n", user, F.nullif(extra, F.lit(""))))


def think_message(entry_point: Column, prompt: Column) -> Column:
    """Baselines: a short reasoning, then code."""
    return message(THINK_ROLE, F.concat(F.lit("Solve this HumanEval problem. The required function name is "), entry_point, F.lit(".\n\n"), prompt, F.lit("\n\n" + THINK_FORM)))


def repair_message(prompt: Column, code_before: Column, feedback: Column, team: bool = False) -> Column:
    """Baselines: a repair, alone or after a tester's feedback."""
    if team:
        return message(TEAM_DEBUGGER + CORRECTED_ONLY, _parts((TASK, prompt), ("Programmer code:\n", code_before), ("Tester/debug feedback:\n", feedback), ("", F.lit(TEAM_REPAIR))))
    return message(DEBUGGER + CORRECTED_ONLY, _parts((TASK, prompt), (BEFORE, code_before), (FEEDBACK, feedback), ("", F.lit("Write a corrected complete Python function."))))


def tester_message(prompt: Column, code: Column) -> Column:
    return message(TESTER_ROLE, _parts((TASK, prompt), ("Programmer code:\n", code), ("", F.lit(TESTER_ASK))))


def debater_message(persona: Column, prompt: Column) -> Column:
    return message(F.concat(F.lit("You are "), persona, F.lit(DEBATER)), F.concat(F.lit(DEBATE_ASK), prompt))


def debate_end_message(entry_point: Column, prompt: Column, plans: Column) -> Column:
    """The last request of a debate, with all plans in order."""
    notes = F.array_join(F.transform(plans, lambda p, i: F.concat(F.lit("Agent "), (i + 1).cast("string"), F.lit(":\n"), p)), "\n\n")
    return message(DEBATE_END_ROLE, F.concat(_parts((TASK, prompt), ("Debate notes:\n", notes)), F.lit("\n\nNow write the complete Python function named "), entry_point, F.lit(".")))


def response_text(value: Column) -> Column:
    """A response given as JSON: of an object its value (empty if it has none), of anything else its own text."""
    is_object = F.regexp_like(value, F.lit(r"(?s)^\s*\{")) & F.get_json_object(value, "$").isNotNull()
    quoted = F.regexp_like(value, F.lit(r'(?s)^\s*"'))
    return F.when(is_object, F.coalesce(F.get_json_object(value, "$.value"), F.lit(""))).when(quoted, F.get_json_object(value, "$")).otherwise(value)
